"""Evidence groups (capsules): building, striping, ordered unions, answer and audit channels.

Groups are bounded windows of at most four sources, so arrays stay small; order-preserving set operations tag rows
with their position and keep the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import modes as M
from palimpsest.functions import text as T

# Words that say that something no longer holds, or still does.
NEGATIVE_STATE = "delete deleted remove removed cancel cancelled canceled complete completed finished stopped drop dropped abandon abandoned forget forgot replaced superseded outdated obsolete expired".split()
NEGATIVE_PHRASES = ["no longer", "done with", "删除", "移除", "取消", "完成了", "不再", "停止", "放弃", "忘记", "替换", "过期", "作废"]
POSITIVE_STATE = "add added create created schedule scheduled plan planned want wants wanted prefer prefers preferred still remain remains remaining active current ongoing keep".split()
POSITIVE_PHRASES = ["新增", "创建", "计划", "想要", "偏好", "仍然", "剩余", "有效", "进行中", "保留"]


def _says(text: Column | str, words: list[str], phrases: list[str]) -> Column:
    lower = F.lower(F.col(text) if isinstance(text, str) else text)
    hit = F.arrays_overlap(F.split(lower, "[^a-z]+"), F.array(*[F.lit(w) for w in words]))
    for p in phrases:
        hit = hit | F.contains(lower, F.lit(p))
    return hit


def says_negative(text: Column | str) -> Column:
    return _says(text, NEGATIVE_STATE, NEGATIVE_PHRASES)


def says_positive(text: Column | str) -> Column:
    return _says(text, POSITIVE_STATE, POSITIVE_PHRASES)


def state_adjustment(text: Column | str, query: Column | None = None) -> Column:
    """Signed mass of a text: -0.18 for an ended state, 0.08 for a present one, -0.04 for both, else 0.

    It counts for questions about the current state only: 0 where ``query`` is about the past or not about the present.
    """
    neg, pos = says_negative(text), says_positive(text)
    own = F.when(neg & ~pos, -0.18).when(pos & ~neg, 0.08).when(neg & pos, -0.04).otherwise(0.0)
    if query is None:
        return own
    return F.when(M.matches(query, "current_words") & ~M.matches(query, "historical"), own).otherwise(0.0)


def state_field(force: Column, adjustment: Column) -> Column:
    return F.greatest(F.lit(0.0), force + adjustment)


def window_capsules(df: DataFrame, group: list[str], order: list[str], id_col: str, size: int = 4) -> DataFrame:
    """(group, sources): pairs of adjacent sources, and windows of ``size`` that share one source with the next.

    Windows of one source do not count; equal capsules come out once.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    rows = df.withColumn("_rn", F.row_number().over(w) - 1)
    ahead = F.collect_list(id_col).over(w.rowsBetween(0, size - 1))
    rows = rows.withColumn("_win", ahead)
    pair = F.slice("_win", 1, 2)
    made = F.array(F.when(F.size("_win") >= 2, pair), F.when((F.col("_rn") % (size - 1) == 0) & (F.size("_win") >= 2), F.col("_win")))
    return rows.select(*group, F.explode(F.array_distinct(F.filter(made, lambda x: x.isNotNull()))).alias("sources")).distinct()


def entity_capsules(df: DataFrame, id_col: str, entities: Column, partition: list[str], most: int = 64, size: int = 4) -> DataFrame:
    """(partition, entity, sources): windows over the sources that share an entity, for entities of 2 to ``most`` sources.

    More widespread entities tell nothing and make no capsule; that bound is part of the definition.
    """
    rows = df.select(*partition, id_col, F.explode(entities).alias("entity")).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy(*partition, "entity"))
    rows = rows.withColumn("_n", n).where((F.col("_n") >= 2) & (F.col("_n") <= most))
    w = Window.partitionBy(*partition, "entity").orderBy(id_col)
    rows = rows.withColumn("_rn", F.row_number().over(w) - 1).withColumn("sources", F.collect_list(id_col).over(w.rowsBetween(0, size - 1)))
    return rows.where((F.col("_rn") % (size - 1) == 0) & (F.size("sources") >= 2)).select(*partition, "entity", "sources")


def capsule_id(kind: Column, sources: Column) -> Column:
    return F.concat(F.lit("cap_"), F.substring(F.sha2(F.concat_ws("|", kind, F.array_join(sources, ",")), 256), 1, 20))


def stripe(satellites: DataFrame, group: str, id_col: str, rank: str, width: int) -> DataFrame:
    """(group, slot, extra): ranked satellites dealt out over the first ``width`` capsules in turn."""
    slot = F.pmod(F.col(rank) - 1, F.lit(width))
    dealt = satellites.groupBy(group, slot.alias("slot")).agg(F.array_sort(F.collect_list(F.struct(rank, id_col))).alias("_x"))
    return dealt.select(group, "slot", F.transform("_x", lambda x: x[id_col]).alias("extra"))


def ordered_union(lists: list[DataFrame], key: list[str], pos: str) -> DataFrame:
    """(key, place): rows of the lists in order, each once, at its first place; every list has columns key and pos."""
    out = None
    for i, d in enumerate(lists):
        part = d.select(*key, F.lit(i).alias("_list"), F.col(pos).alias("_pos"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*key).agg(F.min(F.struct("_list", "_pos")).alias("_p"))


def round_robin(lists: list[DataFrame], group: str, id_col: str, pos: str, limit: int) -> DataFrame:
    """(group, id, place): ranked lists interleaved by depth, each id at its first place, the first ``limit``."""
    out = None
    for i, d in enumerate(lists):
        part = d.select(group, id_col, F.col(pos).alias("_depth"), F.lit(i).alias("_list"))
        out = part if out is None else out.unionByName(part)
    first = out.groupBy(group, id_col).agg(F.min(F.struct("_depth", "_list")).alias("_k"))
    w = Window.partitionBy(group).orderBy("_k", id_col)
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select(group, id_col, "place")


def neighbour_order(seeds: DataFrame, rows: DataFrame, group: str, order: str, rank: str) -> DataFrame:
    """(group, order, place): each seed followed by the rows next to it in its group, without repeats.

    Rows that no seed reaches follow in their own order.
    """
    near = seeds.select(group, F.explode(F.array(F.struct((F.col(rank) * 3).alias("k"), F.col(order).alias("o")), F.struct((F.col(rank) * 3 + 1).alias("k"), (F.col(order) - 1).alias("o")), F.struct((F.col(rank) * 3 + 2).alias("k"), (F.col(order) + 1).alias("o")))).alias("x"))
    first = near.groupBy(group, F.col("x.o").alias(order)).agg(F.min("x.k").alias("k"))
    joined = rows.select(group, order).join(first, [group, order], "left")
    w = Window.partitionBy(group).orderBy(F.col("k").asc_nulls_last(), order)
    return joined.select(group, order, F.row_number().over(w).alias("place"))


def fact_atoms(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, atom, tokens, numbers, state): clauses of a text with their content words, numbers and signed state."""
    clauses = F.split(F.col(text), r"[.!?;\n]+|\s+(?:but|however|although|while)\s+")
    rows = df.select(id_col, F.posexplode(clauses).alias("atom", "clause"))
    rows = rows.withColumn("tokens", F.array_distinct(T.content_words("clause"))).withColumn("numbers", F.array_distinct(F.regexp_extract_all("clause", F.lit("[0-9]+(?:[.,:][0-9]+)*"), F.lit(0))))
    neg, pos = says_negative("clause"), says_positive("clause")
    state = F.when(neg & ~pos, -1).when(pos & ~neg, 1).otherwise(0)
    return rows.where((F.size("tokens") > 0) | (F.size("numbers") > 0)).select(id_col, "atom", "tokens", "numbers", state.alias("state"))
