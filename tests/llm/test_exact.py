"""Exact groups against a plain version."""

import hashlib
from collections import defaultdict

import pytest
from helpers import DOCS, ODD, clashing, documents

from prosemill.llm.exact import exact_groups


def plain(rows, best):
    by = defaultdict(list)
    for k, t in rows:
        by[t or ""].append(k)
    out = []
    for k, t in rows:
        ids = [x for x in by[t or ""] if x is not None]
        keep = best(ids) if ids else None
        out.append((k, keep, len(by[t or ""]), k == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("keep", "best"), [("smallest", min), ("largest", max)])
def test_equals_plain_version(spark, keep, best):
    long = "many words " * 60_000
    rows = list(enumerate(ODD)) + [(50, long), (51, long + " "), (20, long), (3, "a"), (9, "A"), (12, "a "), (11, "á"), (14, "a\u0301"), (-4, "x" * 5000)]
    rows += [(None, "one"), (None, "of null ids"), (None, "of null ids"), (3, "a"), (2, "a"), *[(100 + k, "a third of all") for k in range(40)]]
    got = [tuple(r) for r in exact_groups(clashing(documents(spark, rows)), keep=keep).collect()]
    assert sorted(got, key=str) == plain(rows, best)


def test_odd_calls(spark):
    assert exact_groups(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        exact_groups(documents(spark, [(1, "a")]), keep="first")
