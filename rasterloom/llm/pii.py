"""Personal data: base patterns, and contextual extraction bootstrapped from what they find.

Base matches are the seeds. The words around a seed make lexical patterns (two words before; one
before and one after). Looser shapes (numbers without a plus sign, addresses with ``[at]``, groups of
hexadecimal digits) are candidates, and have patterns as well. Patterns and distinct instances (values
without their punctuation) are the two sides of a graph, which Spark scores in rounds: a pattern by
the share of its instances that are known to be of a kind, an instance by its best accepted pattern.
Instances of accepted patterns are new identifiers, wherever they stand, and support further patterns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.tables import schema_of, scope, stored

KINDS = ("email", "ip", "card", "phone")
#: Characters before and after a match in which the words of its patterns are looked for.
CONTEXT = 160
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Looser shapes: what stands for ``@`` and a dot, numbers with signs between, groups parted by colons.
AT, DOT = re.compile(r" ?(?:@|\[at\]|\(at\)) ?", re.I), re.compile(r" ?(?:\[dot\]|\(dot\)) ?", re.I)
LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?:\.| ?(?:\[dot\]|\(dot\)) ?)[A-Za-z0-9-]++)*+", re.I)
NUMBER = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9])++")
GROUPS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
DIGIT = re.compile(r"[0-9]")
NO_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the digits' check sum fits."""
    total = 0
    for place, sign in enumerate(reversed(digits)):
        value = int(sign) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches from every ``@``: the signs before it back to the last match, and the names behind it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        behind = DOMAIN.match(text, at + 1) if start < at else None
        if behind:
            yield start, behind.end()
            last = behind.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the base matches, by kind and start; ends are exclusive."""
    found = [("email", a, b) for a, b in _emails(text)]
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = NO_DIGITS.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NO_DIGITS.sub("", m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def _loose_emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        behind = LOOSE_DOMAIN.match(text, m.end()) if start < m.start() else None
        if behind:
            yield start, behind.end()
            last = behind.end()


def candidate_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[tuple[str, ...], int, int]]:
    """``(kinds, start, end)`` of looser shapes that touch no base match."""
    found = []
    if "@" in text or "[" in text or "(" in text:
        found += [(("email",), a, b) for a, b in _loose_emails(text)]
    if DIGIT.search(text):
        for m in NUMBER.finditer(text):
            n = len(NO_DIGITS.sub("", m.group()))
            kinds = ("card",) * (12 <= n <= 19) + ("phone",) * (7 <= n <= 15)
            if kinds:
                found.append((kinds, m.start(), m.end()))
        found += [(("ip",), m.start(), m.end()) for m in GROUPS.finditer(text) if DIGIT.search(m.group())]
    taken = sorted((a, b) for _, a, b in base)
    found.sort(key=lambda c: (c[1], -c[2]))
    kept, k, last = [], 0, 0
    for kinds, a, b in found:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        # those before k end by a, and the ones behind it begin no earlier than it does
        if a >= last and not (k < len(taken) and taken[k][0] < b):
            kept.append((kinds, a, b))
            last = b
    return kept


def value_of(kind: str, text: str) -> str:
    """What tells an instance: its digits, or the address as it is usually written."""
    if kind in ("card", "phone"):
        value = NO_DIGITS.sub("", text)
    elif kind == "email":
        value = DOT.sub(".", AT.sub("@", text)).lower()
    else:
        value = text.lower()
    return value if len(value) <= 64 else "#" + hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()


def patterns_of(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a match: ``a b _`` and ``b _ c``, where a letter stands in their words."""
    before = text[max(0, start - CONTEXT) : start].lower().split()[-2:]
    after = text[end : end + CONTEXT].lower().split()[:1]
    found = []
    if len(before) == 2:
        found.append(f"{before[0]} {before[1]} _")
    if before and after:
        found.append(f"{before[-1]} _ {after[0]}")
    return [p for p in found if any(c.isalpha() for c in p)]


SPAN = "struct<kind: string, start: int, end: int>"
SEEN = "struct<kinds: array<string>, start: int, end: int, value: string, patterns: array<string>>"


def _scan(keep: list[str]):
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    seen = pa.struct(
        [("kinds", pa.list_(pa.string())), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]
        + [("patterns", pa.list_(pa.string()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, met = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                own = [((k,), a, b, True) for k, a, b in base]
                own += [(k, a, b, False) for k, a, b in candidate_spans(text, base)]
                met.append(
                    [
                        {
                            "kinds": [("+" if seed else "-") + k for k in kinds],
                            "start": a,
                            "end": b,
                            "value": value_of(kinds[0], text[a:b]),
                            "patterns": patterns_of(text, a, b),
                        }
                        for kinds, a, b, seed in own
                    ]
                )
            out = {c: batch.column(c) for c in keep}
            out |= {"base": pa.array(found, pa.list_(span)), "seen": pa.array(met, pa.list_(seen))}
            yield pa.RecordBatch.from_pydict(out)

    return run


def scanned(df: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ``base`` spans and all that is ``seen`` (kinds with ``+`` for seeds, ``-`` else)."""
    schema = ", ".join(filter(None, [schema_of(df, keep) if keep else "", f"base array<{SPAN}>, seen array<{SEEN}>"]))
    return df.select(*keep, "text").mapInArrow(_scan(keep), schema)


def bootstrapped(
    seen: DataFrame, threshold: int = 700, support: int = 5, rounds: int = 4
) -> tuple[DataFrame, DataFrame]:
    """``(patterns, instances)`` that are accepted: ``pattern, kind, score`` and ``value, kind, score``.

    ``seen`` has a row of ``value, kinds, patterns`` for each occurrence. The graph has each pair of pattern
    and instance once, so copies of a document count once. Scores are whole thousandths: a
    pattern's is the sum of its instances' scores over their number and one; it is accepted from
    ``threshold`` on if the sum is that of ``support`` seeds, so five seeds bear one odd instance. Seeds
    have 1,000, other instances the best score of their accepted patterns. Rounds end when no pattern is
    new, or after ``rounds``.
    """
    kind = F.explode("kinds").alias("marked")
    nodes = seen.select("value", "patterns", kind).select(
        "value", "patterns", F.substring("marked", 2, 9).alias("kind"), F.col("marked").startswith("+").alias("seed")
    )
    # a value that is a seed anywhere is one everywhere
    edges = nodes.select("value", "kind", "seed", F.explode_outer("patterns").alias("pattern"))
    known = edges.groupBy("value", "kind").agg(F.max("seed").alias("seed")).where("seed")
    known = stored(known.select("value", "kind", F.lit(1000).alias("score")), "seeds")
    edges = stored(edges.where("pattern IS NOT NULL").select("pattern", "value", "kind").distinct(), "edges")
    sizes = stored(edges.select("pattern", "value").distinct().groupBy("pattern").count(), "pattern-sizes")
    accepted, before = None, -1
    for _ in range(rounds):
        sums = edges.join(known, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("sum"))
        scored = sums.join(sizes, "pattern").withColumn("score", F.expr("cast(sum div (count + 1) as int)"))
        accepted = stored(scored.where((F.col("score") >= threshold) & (F.col("sum") >= 1000 * support)).select("pattern", "kind", "score"), "patterns")
        now = accepted.count()
        if now == before:
            break
        before = now
        reached = edges.join(accepted, ["pattern", "kind"]).select("value", "kind", "score")
        known = stored(
            known.unionByName(reached).groupBy("value", "kind").agg(F.max("score").alias("score")), "instances"
        )
    return accepted, known


def _text(spans: Column) -> Column:
    place = {k: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*[F.lit(x) for k, i in place.items() for x in (k, i)])
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(df: DataFrame, keep: list[str], threshold: int = 700, support: int = 5, rounds: int = 4) -> DataFrame:
    """Columns ``keep`` with ``base`` and ``added`` spans (kind, start, end in code points) of ``text``.

    Base spans follow from the text alone. Added ones are candidates that touch no base span and whose
    value is an accepted instance (``bootstrapped``), of several kinds the one with the best
    score, the first in ``KINDS`` where even. A null or empty text has no spans; repeated rows have equal
    ones; an empty table stays empty. Of other columns only ``keep`` is read, and may have any names.
    """
    names = [f"_{i}" for i in range(len(keep))]
    read = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col("text").alias("text"))
    with scope(df.sparkSession):
        rows = scanned(read, names).withColumn("uid", F.monotonically_increasing_id())
        rows = stored(rows, "seen", outlives=True)
        seen = rows.select("uid", F.inline("seen"))
        _, instances = bootstrapped(seen, threshold, support, rounds)
        instances = stored(instances, "instances", outlives=True)
    loose = seen.select("uid", "start", "end", "value", F.explode("kinds").alias("marked")).where("marked LIKE '-%'")
    loose = loose.select("uid", "start", "end", "value", F.substring("marked", 2, 9).alias("kind"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    best = F.max(F.struct("score", (-rank).alias("rank"), "kind"))["kind"].alias("kind")
    added = (
        loose.join(instances, ["value", "kind"])
        .groupBy("uid", "start", "end").agg(best)
        .groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    )
    none = F.array().cast(f"array<{SPAN}>")
    return rows.join(added, "uid", "left").select(
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "base", F.coalesce("added", none).alias("added")
    )


def report(found: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, base spans by kind, a digest of them, and all spans as ``kind:start:end`` by kind and start."""

    def of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        *keep,
        *[of(k) for k in KINDS],
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"),
        _text(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
