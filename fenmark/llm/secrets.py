"""Secret scans with corpus-wide ownership frequency.

Base findings (assign, access, hex) are fixed patterns, each matched leftmost and
without overlap.  Further kinds (``MORE``) are candidates.  Every finding's value is hashed;
over the whole corpus the distinct repositories and owners of each hash are counted.
A value is a widely copied example if more than ``MAX_LIVE_REPOS`` repositories hold it, whoever owns them, or more than ``MAX_LIVE_OWNERS`` owners and
more than ``MAX_MIRRORS`` repositories (so that a document which a few owners mirror doesn't make its secret an example); any other
that looks random is live.  Base findings always stay; a candidate becomes a finding only if it is live.

Positions are code points, ends exclusive.  A null or empty text has no findings; repeated
rows are each reported and count as one repository; a null owner is an owner of its own; an empty table gives an empty result;
texts of any length are searched whole, in time that grows with the length and not with length times findings.
Values are hashed before they leave the Python worker.  Hashes are counted by partial
aggregates and looked up by joins that AQE may split, so a value in a third of all rows is no
single task's work.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenmark.llm.runtime import core, written

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
MORE = {
    "github": (re.compile(r"gh[pousr]_[A-Za-z0-9]{20,}"), 0, 24),
    "slack": (re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 15),
    "payment": (re.compile(r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"), 0, 24),
    "google": (re.compile(r"AIza[A-Za-z0-9_-]{35}"), 0, 39),
    "jwt": (re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"), 0, 24),
    "pem": (re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s+([A-Za-z0-9+/=\s]{32,})"), 1, 32),
    "random": (re.compile(r"[A-Za-z0-9+/_-]{24,}"), 0, 24),
}
KINDS = (*BASE, *MORE)
MAX_LIVE_OWNERS, MAX_MIRRORS, MAX_LIVE_REPOS, MIN_ENTROPY = 2, 4, 24, 3.0
#: Values that documentation uses.
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your[_-]|xxxx|(.)\1{7}", re.I)

_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_RUN = bytes(1 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-" else 0 for b in range(256))
_LONG, _MARKS = b"\x01" * 20, (b"AKIA", b"xox", b"PRIVATE KEY", b"eyJ")

_FOUND = "doc_id long, repo string, owner string, found array<struct<kind: int, start: long, end: long, value: binary, base: boolean, random: boolean>>"


def looks_random(value: str) -> bool:
    """Of MIN_ENTROPY bits a character or more, and not a placeholder."""
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return bits >= MIN_ENTROPY and not PLACEHOLDER.search(value)


def _mixed(value: str) -> bool:
    return len(re.findall("[0-9]", value)) >= 3 and len(re.findall("[A-Za-z]", value)) >= 3


def find(text: str) -> list[tuple[int, int, int, str, bool]]:
    """(kind's number, start, end, value, base) of a text, by start and kind."""
    raw = text.encode()
    low = raw.lower()
    worded = any(w in low for w in _WORDS)
    marked = _LONG in raw.translate(_RUN) or any(m in raw for m in _MARKS)
    out, taken = [], bytearray(len(text))
    for k, kind in enumerate(KINDS):
        if not (worded if kind == "assign" else marked):
            continue
        pattern, group, least = BASE.get(kind) or MORE[kind]
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) < least or (kind == "random" and not _mixed(m[0])):
                continue
            if kind in MORE and taken.find(1, m.start(), m.end()) >= 0:
                continue
            taken[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
            out.append((k, m.start(), m.end(), m[group], kind in BASE))
    return sorted(out, key=lambda x: (x[1], x[0]))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """Per row: doc_id, repo, owner and what find() returns, values hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column("text"):
                own = find(t.as_py() or "")
                found.append([{"kind": k, "start": s, "end": e, "value": hashlib.sha256(v.encode()).digest()[:16], "base": b, "random": looks_random(v)} for k, s, e, v, b in own])
            kind = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary()), ("base", pa.bool_()), ("random", pa.bool_())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("repo"), batch.column("owner"), pa.array(found, pa.list_(kind))], ["doc_id", "repo", "owner", "found"])

    return core(docs, key, text, repo=repo, owner=owner).mapInArrow(run, _FOUND)


def ownership(each: DataFrame) -> DataFrame:
    """(value, repos, owners) of (value, repo, owner): exact distinct counts."""
    by_owner = each.groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = each.groupBy("value", "owner").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count("*").alias("owners"))
    repos = by_owner.groupBy("value", "repo").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count("*").alias("repos"))
    return owners.join(repos, "value")


def _named(items: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source", max_live_owners: int = MAX_LIVE_OWNERS, max_mirrors: int = MAX_MIRRORS, max_live_repos: int = MAX_LIVE_REPOS) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, findings.

    findings: kind, start, end, repos, owners, verdict (live, example or unclear) of each span.
    """
    found = written(candidates(docs, key, text, repo, owner).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = found.select("row", "repo", "owner", F.explode("found").alias("x")).select("row", "repo", "owner", "x.*")
    owned = written(ownership(each.select("value", "repo", "owner")), "ownership")
    copied = (F.col("repos") > max_live_repos) | ((F.col("owners") > max_live_owners) & (F.col("repos") > max_mirrors))
    verdict = F.when(copied, "example").when(F.col("random"), "live").otherwise("unclear")
    judged = each.join(owned, "value").withColumn("verdict", verdict).where(F.col("base") | (F.col("verdict") == "live"))
    item = F.struct("start", "kind", "end", "base", "repos", "owners", "verdict")
    rows = judged.groupBy("row").agg(F.sort_array(F.collect_list(item)).alias("spans"))
    out = found.join(rows, "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start: long, kind: int, end: long, base: boolean, repos: long, owners: long, verdict: string>>")))

    def count(field: str, value: int | str) -> Column:
        return F.size(F.filter("spans", lambda x: x[field] == value)).cast("long")

    names = F.array(*(F.lit(k) for k in KINDS))
    return out.select(
        "doc_id",
        *(count("kind", k).alias(f"n_{name}") for k, name in enumerate(BASE)),
        F.sha2(_named(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"),
        _named(F.col("spans")).alias("spans"),
        count("verdict", "live").alias("n_live"),
        count("verdict", "example").alias("n_example"),
        F.transform("spans", lambda x: F.struct(F.element_at(names, x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["repos"].alias("repos"), x["owners"].alias("owners"), x["verdict"].alias("verdict"))).alias("findings"),
    )
