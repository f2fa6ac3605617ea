"""Secret scans against a plain version with Python's re, and the ledger's promise to scan nothing twice."""

import hashlib
import random
import re

import pytest

from tallyform.llm import queries, secrets
from tests.llm.fixture import empty, frame
from tests.oracle import same

NAMES = [r.kind for r in secrets.RULES]


def plain(text, rules=secrets.RULES):
    """(start, rank, kind, stop) by re over the rules as the task words them."""
    worded = {"access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24), "assign": (r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6)}
    out = []
    for i, r in enumerate(rules):
        pattern, group, least = worded.get(r.kind, (r.pattern, 0, 0))
        out += [(m.start(), i, r.kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(out)


def digest(text):
    found = plain(text)
    line = lambda rows: ",".join(f"{k}:{a}:{b}" for a, _, k, b in rows)
    base = [f for f in found if f[1] < 3]
    return (*(sum(f[2] == k for f in found) for k in ("assign", "access", "hex")), hashlib.sha256(line(base).encode()).hexdigest(), line(found))


def texts():
    rng = random.Random(5)
    bits = ["token", "API_KEY", "apikey", "Secret", "passwd", '"', "'", " ", "  ", ":", "=", "abcdef", "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeefdead", "é", "𝒳", "\n", "\t", "ſecret=abcdefg", "toKen=abcdefg", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 10, "xoxb-1234567890-ab", "AIza" + "x_-4" * 9]
    rows = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    rows += [None, "", " ", "secret=token = abcdefgh", "token=token=abc", 'password: "', "AKIA" + "A" * 15, "AKIA" + "A" * 16, "a" * 23, "a" * 24, "x" + "AKIA" * 5, "token" + " " * 50_000 + "= abcdef", "é" * 9 + "token=abcdef" * 3000, "0123456789abcdef" * 20_000, "token:" * 5000]
    return rows + rows[:40]


def test_against_re(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, 1, "b", "f") for i, t in enumerate(rows)], "doc_id long, text string, rules int, blob string, found string").repartition(5)
    got = secrets.digest(secrets.scan_versions(df, queries.scratch_table(spark, "t")))
    assert got.columns == ["doc_id", "rules", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    out = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got.collect()}
    assert len(out) == len(rows)
    for i, t in enumerate(rows):
        assert out[i] == digest(t), (i, t)


def test_equals_sql(spark, sf):
    assert same(spark, sf, queries.op13_secret_ledger, secrets.oracle_sql()) == 200


def test_only_unseen_pairs_are_scanned(spark):
    path = queries.scratch_table(spark, "ledger")
    ledger = lambda: spark.read.parquet(path).collect()
    old = [("a", 1, "token = abcdef1"), ("b", 1, "token = abcdef1"), ("a", 2, "nothing"), ("c", 1, None)]
    cols = "path string, version int, text string"
    first = secrets.scan_versions(spark.createDataFrame(old, cols), path, rules=secrets.BASE)
    assert {(r.path, r.version): [tuple(f) for f in r.found] for r in first.collect()} == {("a", 1): [("assign", 0, 15)], ("b", 1): [("assign", 0, 15)], ("a", 2): [], ("c", 1): []}
    assert len(ledger()) == 3 and all(r.rules == ["assign@1", "access@1", "hex@1"] for r in ledger())
    new = old + [("d", 1, "nothing"), ("b", 2, "AKIA" + "Z" * 16)]
    secrets.scan_unseen(spark.createDataFrame(new, cols), path, rules=secrets.BASE)
    assert len(ledger()) == 4  # one new blob
    more = (secrets.BASE[0], secrets.Rule("access", r"AKIA[A-Z0-9]{16,}", version=2), secrets.BASE[2])
    out = secrets.scan_versions(spark.createDataFrame(new, cols), path, rules=more).collect()
    assert sorted(map(tuple, (r.rules for r in ledger()[:] if len(r.rules) == 1))) == [("access@2",)] * 4  # the changed rule alone, over all blobs
    assert {(r.path, r.version): len(r.found) for r in out} == {("a", 1): 1, ("b", 1): 1, ("a", 2): 0, ("c", 1): 0, ("d", 1): 0, ("b", 2): 1}
    secrets.scan_unseen(spark.createDataFrame(new, cols), path, rules=more)
    assert len(ledger()) == 8
    assert secrets.findings(spark, path, secrets.BASE).count() == 2  # findings of the old version are still there


def test_findings_do_not_depend_on_rows_written_twice(spark):
    path = queries.scratch_table(spark, "ledger")
    df = spark.createDataFrame([(1, "token = abcdef1")], "doc_id int, text string")
    secrets.scan_unseen(df, path)
    spark.read.parquet(path).collect()
    row = spark.createDataFrame(spark.read.parquet(path).collect(), secrets.LEDGER)
    row.write.mode("append").parquet(path)
    assert [len(r.found) for r in secrets.scan_versions(df, path).collect()] == [1]


@pytest.mark.parametrize("make", [empty, lambda s: frame(s, [(None, None), (1, ""), (1, ""), (1, "token='abcdef'")])])
def test_awkward_rows(spark, make):
    df = make(spark)
    out = secrets.digest(secrets.scan_versions(df, queries.scratch_table(spark, "t"))).collect()
    assert sorted((r.doc_id or -1, r.spans) for r in out) == sorted((d or -1, digest(t)[-1]) for d, t in df.select("doc_id", "text").collect())


def test_runs_no_python(spark, sf):
    plan = queries.op13_secret_ledger(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
