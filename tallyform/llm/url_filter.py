"""URL verdicts: allow and block rules first, else logistic regression on hashed character n-grams.

The model is fitted on the driver from a small labelled table of hosts and paths (an argument; a
default of about 450 lies beside this module), so its size is bounded by that table and by the number
of hash buckets. Scoring runs over slices of Arrow batches without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices

BUCKETS, GRAMS, ROUNDS, RATE, DECAY, CUT = 1 << 16, (3, 4, 5), 200, 0.5, 1e-5, 0.4

#: Rules of the production query: verdict and host with path prefix (fixed values).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)

#: Labelled urls, one a line: 1 (unwanted) or 0, a space, the url. Lines with # are remarks.
LABELLED = Path(__file__).with_name("labelled_urls.txt")
_NUMBER = re.compile("[0-9]+")


def labelled_urls(path: Path = LABELLED) -> list[tuple[str, str, int]]:
    """(host, path, unwanted) rows of the table in this folder; the driver alone reads it."""
    lines = [x for x in path.read_text(encoding="utf-8").split("\n") if x and not x.startswith("#")]
    return [(*split_url(x[2:]), int(x[0])) for x in lines]


def split_url(url: str | None) -> tuple[str, str]:
    """Driver-side twin of host_path."""
    _, at, rest = (url or "").partition("://")
    host = re.match("[^/?#]*", rest)[0] if at else ""
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0] if at else ""


def grams(hosts: Sequence[str], paths: Sequence[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct character n-grams of ^host$ and ^path$, by row; numbers count as 0.

    All rows are hashed at once; grams of hosts and of paths are told apart.
    """
    parts = [_NUMBER.sub("0", f"^{x}$").encode("utf-8", "surrogatepass") for h, p in zip(hosts, paths) for x in (h, p.lower())]
    end = np.cumsum([len(x) for x in parts]) if parts else np.empty(0, np.int64)
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    part = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    keys = []
    for n in GRAMS:
        at = np.arange(max(len(raw) - n + 1, 0))
        at = at[at + n <= end[part[at]]]
        h = (part[at] & 1).astype(np.uint64) + np.uint64(2 * n)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + raw[at + j]
        keys.append((part[at] // 2) * buckets + (mix(h) % np.uint64(buckets)).astype(np.int64))
    key = np.concatenate(keys)
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key // buckets, key % buckets


def fit(rows: Sequence[tuple[str, str, int]], buckets: int = BUCKETS, rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY) -> np.ndarray:
    """Weights by bucket, with the bias last: L2-regularised logistic regression by full gradient steps,
    scaled per weight by the gradients so far (AdaGrad).

    Grams of a row are scaled to unit length. The result depends on the rows only.
    """
    w = np.zeros(buckets + 1)
    if not rows:
        return w
    row, col = grams([h for h, _, _ in rows], [p for _, p, _ in rows], buckets)
    val = 1.0 / np.sqrt(np.bincount(row, minlength=len(rows))[row])
    y = np.array([float(label) for *_, label in rows])
    seen = np.full(buckets + 1, 1e-12)
    grad = np.empty(buckets + 1)
    for _ in range(rounds):
        z = np.bincount(row, w[col] * val, len(rows)) + w[-1]
        g = (1 / (1 + np.exp(-z)) - y) / len(rows)
        grad[:-1], grad[-1] = np.bincount(col, g[row] * val, buckets) + decay * w[:-1], g.sum()
        seen += grad * grad
        w -= rate * grad / np.sqrt(seen)
    return w


@lru_cache(1)
def default_model() -> np.ndarray:
    return fit(labelled_urls())


def scores(w: np.ndarray, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    """Chance that each url is unwanted."""
    row, col = grams(hosts, paths, len(w) - 1)
    size = np.maximum(np.bincount(row, minlength=len(hosts)), 1)
    return 1 / (1 + np.exp(-(np.bincount(row, w[col], len(hosts)) / np.sqrt(size) + w[-1])))


def score(w: np.ndarray, host: str, path: str) -> float:
    return float(scores(w, [host], [path])[0])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            hosts, paths = batch.column("host"), batch.column("path")
            size = np.asarray(pc.add(pc.binary_length(hosts), pc.binary_length(paths)), np.int64)
            for a, b in slices(np.concatenate([[0], np.cumsum(size)])):
                got = scores(w, hosts.slice(a, b - a).to_pylist(), paths.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(got, pa.float64())], [*batch.schema.names, "score"])

    return run


def host_path(url) -> tuple:
    """Host and path columns of a url; both empty for null or where there is no ://."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_column(host, path, rules: Sequence[tuple[str, str]] = RULES):
    """struct(rule, verdict) of the longest rule that fits; of equally long ones the first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(enumerate_rules(rules), key=lambda r: len(r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def enumerate_rules(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Rules in reverse, so that a stable sort leaves the first of equally long ones to be tried first."""
    bad = [r for r in rules if r[0] not in ("allow", "block")]
    if bad:
        raise ValueError(f"verdicts are allow or block: {bad}")
    return list(reversed(rules))


def judge(urls: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, str, int]] | None = None, cut: float = CUT) -> DataFrame:
    """urls with host, path, rule, verdict and score appended (earlier columns of these names are replaced).

    Null urls, and those without ://, have empty host and path, fit no rule with a host and are judged by the model
    (which allows them). score is the model's chance that the url is unwanted; the verdict is the
    rule's where one fits, else block from `cut` on. Rows repeat and keep their columns.
    """
    w = default_model() if labelled is None else fit(labelled)
    host, path = host_path(url)
    own = [c for c in urls.columns if c not in ("host", "path", "score", "rule", "verdict")]
    base = urls.select(*[F.col(f"`{c}`") for c in own], host.alias("host"), path.alias("path"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    scored = base.mapInArrow(_score(urls.sparkSession.sparkContext.broadcast(w)), fields + ", score double")
    ruled = scored.withColumn("__tf_rule", rule_column(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("__tf_rule.verdict"), F.when(F.col("score") >= cut, "block").otherwise("allow"))
    return ruled.select(*[F.col(f"`{c}`") for c in own], "host", "path", F.col("__tf_rule.rule").alias("rule"), verdict.alias("verdict"), "score")
