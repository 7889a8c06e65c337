"""Questions against the rows of their part that share a word with them: the best of each by a law, block by block.

Texts are cut into sets once per row, before anything meets. Pairs exist only within a block, as numbers of shared
members; each block leaves the best few rows of a question.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from palimpsest.operators import lexical as L
from palimpsest.session import materialize

Arrays = dict[str, np.ndarray]
#: Rows and questions of a part that meet in one block, and buckets of parts that may share a block.
BLOCK, BUCKETS = 8192, 1024
#: Cells (question x row) and shared members that are held at once, as far as one question allows.
CELLS, HITS = 2_000_000, 1_000_000


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
    """(lengths, values) of a column of lists."""
    chunks = table[name].chunks
    n = [c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in chunks]
    kind = table.schema.field(name).type.value_type
    return np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64), pa.concat_arrays([c.flatten() for c in chunks]) if chunks else pa.array([], kind)


def _codes(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Equal values of both get equal numbers; those of the left come first."""
    codes = pa.concat_arrays([left, right]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes[: len(left)], codes[len(left) :]


class _Shared:
    """Postings of the rows for the members of the questions of one block."""

    def __init__(self, q: pa.Table, m: pa.Table, name: str, q_part: np.ndarray, m_part: np.ndarray):
        (self.q_size, qv), (self.m_size, mv) = _lists(q, name), _lists(m, name)
        qc, mc = _codes(qv, mv)
        row = np.repeat(np.arange(len(self.m_size)), self.m_size)
        most = int(qc.max()) + 1 if len(qc) else 0
        asked = mc < most
        row, mc = row[asked], mc[asked]
        # a member counts within its part
        qc, mc = np.repeat(q_part, self.q_size) * most + qc, m_part[row] * most + mc
        terms, self.term = np.unique(qc, return_inverse=True)
        at = np.searchsorted(terms, mc)
        known = at < len(terms)
        known[known] = terms[at[known]] == mc[known]
        row, at = row[known], at[known]
        self.rows = row[np.argsort(at, kind="stable")]
        self.count = np.bincount(at, minlength=len(terms))
        self.first = np.cumsum(self.count) - self.count
        self.entry = np.concatenate([[0], np.cumsum(self.q_size)])
        hits = self.count[self.term] if len(terms) else np.zeros(0, np.int64)
        self.hits = np.concatenate([[0], np.cumsum(hits)])[self.entry]  # of all questions before

    def cells(self, a: int, b: int, width: int) -> np.ndarray:
        """Numbers of shared members of the questions a to b with all rows, question by question."""
        term = self.term[self.entry[a] : self.entry[b]]
        n = self.count[term]
        question = np.repeat(np.arange(b - a), self.q_size[a:b])
        at = np.repeat(self.first[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(np.repeat(question * width, n) + self.rows[at], minlength=(b - a) * width)


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Halves of the scaled double go away from 0, as DuckDB rounds; Spark's round looks at the decimal digits instead."""
    y = np.abs(x) * 10.0**digits
    r = np.rint(y)
    return np.copysign((r + (y - r == 0.5)) / 10.0**digits, x)


def rounded_column(x: Column, digits: int) -> Column:
    """The same as a column."""
    y = F.abs(x) * 10.0**digits
    r = F.rint(y)
    return F.when(x < 0, -1.0).otherwise(1.0) * F.when(y - r == 0.5, r + 1.0).otherwise(r) / 10.0**digits


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best k scores; of equal ones the first."""
    if len(score) <= k:
        return np.arange(len(score))
    s = np.where(np.isnan(score), np.inf, score)  # as in SQL, above all numbers
    least = np.partition(s, len(s) - k)[len(s) - k]
    over = np.flatnonzero(s > least)
    return np.concatenate([over, np.flatnonzero(s == least)[: k - len(over)]])


def best_by_law(questions: DataFrame, rows: DataFrame, part: str, query_id: str, id_col: str, sets: list[str], law: Callable[[Arrays, Arrays, Arrays], np.ndarray], score: str, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, id_col, score, rank): the k best rows of its part for each question, by score rounded to 6 digits, ties by id.

    Both sides have their id, the part, arrays of distinct members under the names in ``sets``, and numbers. Rows that
    share no member of the first set are no candidates. ``law`` gets, each as arrays over the same pairs, the numbers of
    shared members by set, then the numbers of the questions and of the rows, with the size of each set as n_(set).
    Exact: every pair is scored. A part is cut into blocks of ``block`` questions and rows by hash of their ids; null
    parts and ids match nothing.
    """
    q = materialize(questions.where(F.col(part).isNotNull() & F.col(query_id).isNotNull()), "pairing_questions")
    m = rows.where(F.col(part).isNotNull() & F.col(id_col).isNotNull())
    cuts = lambda df, name: df.groupBy(F.col(part).alias("_p")).agg(F.ceil(F.count(F.lit(1)) / block).alias(name))
    sizes = materialize(cuts(m, "_mn").join(cuts(q, "_qn"), "_p"), "pairing_sizes")

    def cut(df: DataFrame, key: str, own: str, n: str, other: str, rest: str) -> DataFrame:
        j = df.join(sizes, F.col(part) == F.col("_p")).withColumn(own, F.pmod(F.xxhash64(key), F.col(n)))
        j = j.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(rest) - 1)))
        return j.withColumn("_g", F.pmod(F.xxhash64(part), F.lit(BUCKETS))).drop("_p", "_mn", "_qn").groupBy("_g", "_qb", "_mb")

    q_fields = [c for c in q.columns if c not in (part, query_id, *sets)]
    m_fields = [c for c in m.columns if c not in (part, id_col, *sets)]
    schema = StructType([q.schema[query_id], m.schema[id_col], StructField(score, DoubleType())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by(id_col)
        qn, mn = left.num_rows, right.num_rows
        empty = pa.table({query_id: left[query_id][:0], id_col: right[id_col][:0], score: pa.array([], pa.float64())})
        if not qn or not mn:
            return empty
        where = _codes(left[part].combine_chunks(), right[part].combine_chunks())
        shared = {s: _Shared(left, right, s, *where) for s in sets}
        qf = {c: left[c].to_numpy() for c in q_fields} | {f"n_{s}": x.q_size for s, x in shared.items()}
        mf = {c: right[c].to_numpy() for c in m_fields} | {f"n_{s}": x.m_size for s, x in shared.items()}
        hits = sum(x.hits for x in shared.values())
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        a = 0
        while a < qn:
            b = max(a + 1, min(qn, a + CELLS // mn, int(np.searchsorted(hits, hits[a] + HITS, "right")) - 1))
            cells = {s: x.cells(a, b, mn) for s, x in shared.items()}
            at = np.flatnonzero(cells[sets[0]])
            qi, mi = np.divmod(at, mn)
            value = rounded(law({s: c[at] for s, c in cells.items()}, {c: v[a + qi] for c, v in qf.items()}, {c: v[mi] for c, v in mf.items()}))
            ends = np.searchsorted(qi, np.arange(b - a + 1))
            best = [start + _best(value[start:end], k) for start, end in zip(ends[:-1], ends[1:], strict=True) if end > start]
            if best:
                kept = np.concatenate(best)
                out.append((a + qi[kept], mi[kept], value[kept]))
            a = b
        if not out:
            return empty
        x, y, v = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({query_id: left[query_id].take(pa.array(x)), id_col: right[id_col].take(pa.array(y)), score: pa.array(v)})

    found = cut(q, query_id, "_qb", "_qn", "_mb", "_mn").cogroup(cut(m, id_col, "_mb", "_mn", "_qb", "_qn")).applyInArrow(meet, schema)
    return L.top_k(found, query_id, id_col, score, k)
