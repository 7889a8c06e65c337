"""Look-alike letters that cannot be read are an error, not a shorter list."""

import pytest

from palimpsest.llm import canonical
from palimpsest.llm.neardup import NearDupConfig, near_duplicate_pairs


class _Checker:
    """A library that answers with only part of what it was asked."""

    def __getattr__(self, name):
        return self

    def __call__(self, *args):
        return self

    def getSkeleton(self, text):
        return "\n".join(text.split("\n")[:60])


class _Session:
    def __init__(self, jvm):
        self._jvm = jvm


@pytest.mark.parametrize("jvm", [object(), _Checker()])
def test_no_answer_or_part_of_one_is_an_error(jvm):
    with pytest.raises(RuntimeError, match="look-alike letters"):
        canonical.public_letters(_Session(jvm))


def test_queries_fail_with_it(spark, monkeypatch):
    def fail(*args):
        raise OSError("the connection to the JVM is lost")

    monkeypatch.setattr(canonical, "_public", fail)
    df = spark.createDataFrame([("w", 1, "Google Play"), ("w", 2, "Google \u13e2lay")], "src string, id long, text string")
    for query in (canonical.same_look_pairs, lambda *x: near_duplicate_pairs(*x, NearDupConfig()), lambda d, g, i, t: canonical.with_canonical(d, t, "form")):
        with pytest.raises(RuntimeError, match="look-alike letters"):
            query(df, "src", "id", "text")
