"""Modes, budgets and weights of a query, from its wording: pure column expressions over one small query table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.patterns import pattern

# Words of a question that tell its mode, in the notation of palimpsest.functions.patterns.
WORDS: dict[str, str] = {
    "broad_set": """all, every, each, list, remain, remains, remaining, current {task tasks item items project projects}, what {task tasks activities events books movies places things preferences},
        which {task tasks activities events books movies places things}, summarise, summarize, overview, in total, complete list, across {the all}, todo list, to-do list, upcoming event, upcoming events, total,
        how many, how much, which {week month day} .. {most least}, meeting my .. goal, recommend, recommendation, recommendations, recommended, suggest, suggestion, suggestions, suggested,
        based on my preferences, topics i'm interested in, topics i am interested in, genres i enjoy, directors i prefer, artists i like, preferred type, preferred types,
        全部, 所有, 每个, 列出, 还有哪些, 剩余, 当前任务, 完整列表, 总结""",
    "current_words": "current, currently, now, latest, still, remain, remains, remaining, active, today, present, up to date, up-to-date, up-to date, up to-date, most recent, todo, to-do, 当前, 现在, 最新, 仍然, 剩余, 有效, 今天",
    "historical": "previously, formerly, used to, historical, history, before, old, past, what changed, how .. changed, evolve, evolved, evolving, 以前, 过去, 历史, 曾经, 如何变化, 演变",
    "inference": """would, likely, could, personality, political, religious, identity, relationship status, career path, activities, events, books, things, ways, interest, interests, participate, participated,
        what does .. do, where has .., has .. {done read visited camped}""",
    "temporal_point": "when, what date, how long, how many {days weeks months years}, how long ago",
    "causal": "why, how did, plan, plans, relationship, change, changed, develop, developed, realize, realized, realizes",
    "deep_graph": "ultimately, associated, through, chain, linked, trace, derive, indirect, eventually, relationship path, 最终, 关联, 链路, 追溯, 间接, 关系路径",
    "negated": "not, never, no, without, didn't, doesn't, isn't, wasn't, didnt, doesnt, isnt, wasnt, didn’t, doesn’t, isn’t, wasn’t, 不是, 没有, 未曾, 从未, 不再, 并非",
    "time_words": "when, before, after, current, latest, previous, history, 何时, 之前, 之后, 当前, 现在, 最新, 曾经, 历史",
    "graph_words": "why, how, related, relationship, depends, through, 为什么, 如何, 关系, 关联, 依赖, 通过",
    "task": """how {do can should would}, show me how, implement, write {code function class query}, write {a the} {code function class query}, code, recommend, suggest, what {library libraries tool tools framework},
        怎么, 如何, 实现, 代码, 推荐, 建议, 用什么""",
    "preference": "recommend, suggest, which {one tool library framework}, what {should library libraries tool tools framework}, choose, 推荐, 建议, 选择, 用什么, 哪个好",
    "episodic": """in order, in what order, in which order, chronolog*, timeline, first, then, before, after, throughout, across {conversation* session*}, across {our the} {conversation* session*}, progress*,
        comprehensive summary, summar*, how many, all *, different aspects, 顺序, 时间线, 先后, 之前, 之后, 整个过程, 总结, 进展, 多少""",
    "contradiction": "contradict*, conflict*, which {is was} correct, 矛盾, 冲突, 哪个正确",
    "indirect": """why, would, might, likely, potential, potentially, suspect, suspected, state, country, live, during, before, after, challenge, challenges, personality, trait, traits, relationship, compare, differ,
        difference, different, and how""",
}
PATTERNS: dict[str, str] = {k: pattern(v) for k, v in WORDS.items()}
# Identifiers with a number, and versions.
PATTERNS["exact"] = r"[A-Za-z]+[-_.:/][0-9]|\b[0-9]+(?:\.[0-9]+)+\b"
PATTERNS["years"] = r"\b(?:19|20)[0-9]{2}\b"
# Shares of the retrieval signals before they are scaled and brought to a sum of 1.
SIGNAL_WEIGHTS = {"semantic": 0.28, "bm25": 0.17, "entity": 0.13, "temporal": 0.10, "graph": 0.12, "authority": 0.08, "utility": 0.07, "neural": 0.05}


def matches(query: Column, name: str) -> Column:
    return F.rlike(F.lower(query), F.lit(PATTERNS[name]))


def query_modes(query: Column) -> dict[str, Column]:
    hist, task = matches(query, "historical"), matches(query, "task")
    conflict = matches(query, "contradiction")
    return {
        "broad_set": matches(query, "broad_set"), "current_state": matches(query, "current_words") & ~hist, "historical": hist, "instructions": task | conflict,
        "preferences": matches(query, "preference") | task | conflict, "episodic": matches(query, "episodic"), "contradiction": conflict,
    }


def satellite_budget(query: Column, ceiling: int = 20) -> Column:
    return F.least(F.lit(ceiling), F.when(matches(query, "inference"), 20).when(matches(query, "temporal_point"), 6).when(matches(query, "causal"), 12).otherwise(8))


def constellation_budget(query: Column, default: int = 16, ceiling: int = 48) -> Column:
    return F.least(F.lit(ceiling), F.when(matches(query, "broad_set"), 40).when(matches(query, "historical"), 24).otherwise(default))


def hop_limit(query: Column) -> Column:
    return F.when(matches(query, "deep_graph"), 8).otherwise(4)


def signal_weights(query: Column) -> dict[str, Column]:
    time, graph, exact = matches(query, "time_words") | matches(query, "years"), matches(query, "graph_words"), matches(query, "exact")
    scale = {"temporal": F.when(time, 1.9).otherwise(1.0), "graph": F.when(graph, 1.8).otherwise(1.0), "entity": F.when(graph, 1.35).otherwise(1.0), "bm25": F.when(exact, 1.7).otherwise(1.0)}
    raw = {k: F.lit(w) * scale.get(k, F.lit(1.0)) for k, w in SIGNAL_WEIGHTS.items()}
    total = sum(raw.values(), F.lit(0.0))
    return {k: v / total for k, v in raw.items()}


def widened_budget(query: Column, base: Column, ceiling: int = 288) -> Column:
    """Three times the base for questions whose evidence is likely indirect, at most the ceiling."""
    least = F.greatest(F.lit(1), base)
    return F.when(matches(query, "indirect"), F.least(F.greatest(least, F.lit(ceiling)), 3 * least)).otherwise(least)


def sql_matches(query: str, name: str) -> str:
    p = PATTERNS[name].replace("'", "''")
    return f"regexp_matches(lower({query}), '{p}')"
