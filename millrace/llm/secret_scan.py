"""Secret scan: certain finds by pattern, and weak ones only where complementary parts of a credential stand together.

A credential has parts: an identifier (who), a secret (proof) and an endpoint (where). One pass over the texts finds
certain spans (assign, access, hex) and weak candidates: user names and mail addresses (ident), short or bare secrets
(secret), addresses of hosts (endpoint). A weak candidate says little alone, so it is reported only if a part that
completes it is near: a secret for identifiers and endpoints, an identifier or endpoint for secrets; certain
spans count as parts too. Near means: in the same scope (a paragraph, up to a blank line) and at most ``REACH``
characters apart. That is an interval join on document, scope and position: intervals widened by ``REACH`` are dealt
to bins of ``BIN`` characters, and each side keeps what has a partner (semi-joins, so no pairs are made). Documents that
hold no two complementary parts, nearly all, never enter it.

Positions are code points, ends exclusive. Weak candidates of a kind that overlap each other count once (the earliest,
then the longest), and a weak secret that overlaps a certain span is dropped.

Defined cases: a null text is empty and has no spans; repeated rows are scanned each and have equal results; a null doc_id
stays null; very long texts are whole, every pattern runs in time that grows with the text; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
WHO, PROOF, WHERE = range(3)
ROLES = {"assign": PROOF, "access": WHO, "hex": PROOF, "ident": WHO, "secret": PROOF, "endpoint": WHERE}
BASE = 3  # kinds that are certain
REACH = 400
BIN = 512
LONG = 12  # characters from which an assigned value is certain
SHORT = 4  # and from which it is a candidate


def _either(words: str) -> str:
    """An alternative of words in either case of ASCII letters."""
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words.split())


_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
# What the certain kinds are.
ASSIGN = re.compile(rf"""(?:{_either("password passwd secret token apikey api_key")}){_GIVEN}([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
# The candidates.
LOOSE = re.compile(rf"""(?:{_either("pwd pass passphrase passcode key auth bearer credential credentials")}){_GIVEN}([A-Za-z0-9+/_.=-]{{6,}})""")
BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
USER = re.compile(rf"""(?:{_either("username user login account client_id clientid access_key access_key_id email")}){_GIVEN}([A-Za-z0-9@+/_.-]{{3,}})""")
MAIL = re.compile(r"@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}")
MAILBOX = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
HOST = re.compile(rf"""(?:{_either("hostname host endpoint server url")}){_GIVEN}([A-Za-z0-9:/._-]{{3,}})""")
ADDRESS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,19}\Z")
REST = re.compile(r"""[^\x00-\x20"'<>`]*""")
BLANK = re.compile(r"\n[\x20\t\r]*\n")


def certain(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of certain spans; (start, end) of assigned values that are too short for one."""
    spans, short = [], []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            n = m.end(1) - m.start(1)
            if n >= LONG:
                spans.append((m.start(), 0, m.end()))
            elif n >= SHORT:
                short.append(m.span())
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans), short


def _once(spans: list[tuple[int, int]], taken: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """The earliest, then longest of overlapping spans, without those that overlap one of ``taken``."""
    out, end, at, reach = [], -1, 0, -1
    taken = sorted(taken)
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][1])
            at += 1
        if a >= end and reach <= a:
            out.append((a, b))
            end = b
    return out


def _mixed(value: str) -> bool:
    return any(c.islower() for c in value) and any(c.isupper() for c in value) and any(c.isdigit() for c in value)


def candidates(text: str, spans: list[tuple[int, int, int]], short: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of weak candidates."""
    who, proof, where = [], list(short), [m.span() for m in ADDRESS.finditer(text)]
    proof += [m.span() for m in BARE.finditer(text) if _mixed(m[0])]
    if ":" in text or "=" in text:
        who += [m.span() for m in USER.finditer(text)]
        proof += [m.span() for m in LOOSE.finditer(text)]
        where += [m.span() for m in HOST.finditer(text)]
    if "@" in text:
        for m in MAIL.finditer(text):
            if box := MAILBOX.search(text, max(0, m.start() - 64), m.start()):
                who.append((box.start(), m.end()))
    at = text.find("://")
    while at >= 0:
        end = REST.match(text, at + 3).end()
        if scheme := SCHEME.search(text, max(0, at - 20), at):
            where.append((scheme.start(), end))
        at = text.find("://", end)
    found = ((3, _once(who)), (4, _once(proof, [(a, b) for a, _, b in spans])), (5, _once(where)))
    return sorted((a, kind, b) for kind, some in found for a, b in some)


_PART = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("scope", pa.int64())])
_SCAN = "doc_id bigint, spans array<struct<start: bigint, kind: int, end: bigint, scope: bigint>>, weak array<struct<start: bigint, kind: int, end: bigint, scope: bigint>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, certain spans, candidates where their document holds what would complete them)."""
    for batch in batches:
        spans, weak = [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            sure, short = certain(text)
            maybe = candidates(text, sure, short)
            roles = {ROLES[KINDS[k]] for _, k, _ in sure} | {ROLES[KINDS[k]] for _, k, _ in maybe}
            if not maybe or PROOF not in roles or len(roles) == 1:
                maybe = []
            blank = [m.start() for m in BLANK.finditer(text)] if maybe else []
            spans.append([(a, k, b, bisect_right(blank, a)) for a, k, b in sure])
            weak.append([(a, k, b, bisect_right(blank, a)) for a, k, b in maybe])
        lists = [pa.array([[dict(zip(("start", "kind", "end", "scope"), p, strict=True)) for p in x] for x in rows], pa.list_(_PART)) for rows in (spans, weak)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "spans", "weak"])


KEY = ("doc_id", "spans", "weak")


def _completed(some: DataFrame, by: DataFrame) -> DataFrame:
    """Rows of ``some`` that have one of ``by`` within reach: an interval semi-join on bins."""
    bins = lambda a, b: F.sequence(F.floor(F.greatest(a, F.lit(0)) / BIN), F.floor(F.greatest(b, F.lit(0)) / BIN))
    left = some.withColumn("bin", F.explode(bins(F.col("start") - REACH, F.col("end") + REACH)))
    right = by.select(F.col("key").alias("k"), F.col("scope").alias("s"), F.col("start").alias("a"), F.col("end").alias("b"), F.explode(bins(F.col("start"), F.col("end"))).alias("c"))
    near = (F.col("a") <= F.col("end") + REACH) & (F.col("b") >= F.col("start") - REACH)
    met = left.join(right, (F.col("key") == F.col("k")) & (F.col("scope") == F.col("s")) & (F.col("bin") == F.col("c")) & near, "left_semi")
    return met.select("key", "start", "kind", "end").distinct()


def find(documents: DataFrame) -> DataFrame:
    """(doc_id, spans, linked): certain spans and completed candidates of every document, as sorted arrays of (start, kind, end)."""
    scratch = Scratch(documents.sparkSession)
    found = scratch.save(documents.select("doc_id", "text").mapInArrow(_scan, _SCAN), "found")
    open_ = found.where(F.size("weak") > 0).withColumn("key", F.sha2(F.to_json(F.struct(*KEY)), 256))
    roles = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLES[k])))
    parts = open_.dropDuplicates(["key"]).select("key", F.explode(F.concat("spans", "weak")).alias("p")).select("key", "p.*")
    parts = scratch.save(parts.withColumn("role", F.element_at(roles, F.col("kind"))), "parts")
    weak, proof = F.col("kind") >= BASE, F.col("role") == PROOF
    linked = _completed(parts.where(weak & proof), parts.where(~proof)).unionByName(_completed(parts.where(weak & ~proof), parts.where(proof)))
    linked = linked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))
    bare = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).alias("spans")
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    closed = found.where(F.size("weak") == 0).select("doc_id", bare, none.alias("linked"))
    return closed.unionByName(open_.join(linked, "key", "left").select("doc_id", bare, F.coalesce("linked", none).alias("linked")))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(documents: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    n = lambda i: F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("bigint")
    every = F.array_sort(F.concat("spans", "linked"))
    return find(documents).select(
        "doc_id", *(n(i).alias(f"n_{KINDS[i]}") for i in range(BASE)), F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"), _listed(every).alias("spans")
    )
