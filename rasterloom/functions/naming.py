"""File-name expressions: sanitising, step names, frame names, output names, free names."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.binding import let
from rasterloom.functions.positions import number_within
from rasterloom.session import cut_lineage

# Fixed values.
UNSAFE = r'[<>:"/\\|?*]'
CONTROL = r"[\x00-\x1f\x7f]"
LONGEST = 255
DEFAULT_PATTERN = "{video_id}_frame_{index:06d}.{ext}"


def sanitize_name(name) -> Column:
    """A name without unsafe or control characters, at most 255 characters, never empty."""
    c = F.col(name) if isinstance(name, str) else name
    c = F.regexp_replace(c, UNSAFE, "_")
    c = F.regexp_replace(c, CONTROL, "")
    c = F.regexp_replace(c, "__+", "_")
    return let(F.trim(c, F.lit(". ")), _fitted)


def _fitted(c: Column) -> Column:
    tail = F.when(c.contains("."), F.substring_index(c, ".", -1)).otherwise(F.lit(""))
    return (
        F.when(c == "", F.lit("unnamed"))
        .when(F.length(c) <= LONGEST, c)
        .otherwise(let(tail, lambda t: _shortened(c, t)))
    )


def _shortened(c: Column, tail: Column) -> Column:
    """The first characters of a too long name, with its tail after the last dot kept.

    A tail longer than the limit leaves no room, and cuts the rest from its end instead.
    """
    room = F.lit(LONGEST - 1) - F.length(tail)
    rest = F.greatest(F.lit(0), F.length(c) - F.length(tail) - 1 + room)
    kept = F.when(room >= 0, room).otherwise(rest)
    with_tail = F.concat(F.substring(c, F.lit(1), kept), F.lit("."), tail)
    return F.when(tail == "", F.substring(c, 1, LONGEST)).otherwise(with_tail)


def clean_step_name(name) -> Column:
    """Letters, digits, ``-``, ``_`` and inner spaces; a blank name is an error."""
    c = F.col(name) if isinstance(name, str) else name
    blank = F.trim(F.regexp_replace(c, r"\s", " ")) == ""
    cleaned = F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_ -]", ""))
    return F.when(blank, F.raise_error(F.lit("step name cannot be empty")).cast("string")).otherwise(
        cleaned
    )


def step_name(name: str) -> str:
    """:func:`clean_step_name` for one name on the driver."""
    if not name or not name.strip():
        raise ValueError("step name cannot be empty")
    return "".join(ch for ch in name if ch.isalnum() or ch in "-_ ").strip()


def output_name(name, step: str, index: int) -> Column:
    """``{step}_{stem}_step{index:02d}.jpg``; applied step after step the names nest."""
    c = F.col(name) if isinstance(name, str) else name
    stem = F.regexp_replace(c, r"^(.+)\.[^.]+$", "$1")
    return F.concat(F.lit(f"{step}_"), stem, F.lit(f"_step{index:02d}.jpg"))


def _field(name: str, spec: str, values: dict[str, Column]) -> Column:
    """One placeholder as a column; a spec the field does not take is a ValueError."""
    if name not in values:
        raise KeyError(name)
    if spec == "":
        return values[name].cast("string")
    if name == "index" and re.fullmatch(r"0?\d*d", spec):
        return F.format_string("%" + spec, values[name].cast("long"))
    shape = re.fullmatch(r"(0?)(\d*)(?:\.(\d+))?f", spec)
    if name != "timestamp" or not shape:
        raise ValueError(spec)
    zero, width, places = shape.groups()
    places = 6 if places is None else int(places)
    # A decimal pattern rounds the exact binary value, half to even.
    pattern = "0" + ("." + "0" * places if places else "")
    number = F.call_function("format_number", values[name].cast("double"), F.lit(pattern))
    if not width:
        return number
    short = F.length(number) < int(width)
    return F.when(short, F.lpad(number, int(width), zero or " ")).otherwise(number)


def frame_name(
    video_id,
    index,
    timestamp=None,
    ext: str = "jpg",
    pattern: str = DEFAULT_PATTERN,
) -> Column:
    """A frame's file name from ``{video_id} {index} {timestamp} {ext}``.

    The pattern is turned into one expression on the driver; one that cannot be formatted falls
    back to the default. A name with ``/``, ``\\`` or ``..`` raises an error.
    """
    as_column = lambda v: F.col(v) if isinstance(v, str) else v
    values = {
        "video_id": sanitize_name(as_column(video_id).cast("string")),
        "index": as_column(index),
        "ext": F.lit(ext),
    }
    if timestamp is not None:
        values["timestamp"] = as_column(timestamp)

    def compiled(text: str) -> Column:
        parts = []
        for literal, name, spec, conversion in string.Formatter().parse(text):
            parts.append(F.lit(literal))
            if name is not None:
                if conversion:
                    raise ValueError(conversion)
                parts.append(_field(name, spec or "", values))
        return F.concat(*parts) if parts else F.lit("")

    try:
        name = compiled(pattern)
    except (KeyError, ValueError):
        name = compiled(DEFAULT_PATTERN)
    bad = name.contains("/") | name.contains("\\") | name.contains("..")
    error = F.raise_error(F.concat(F.lit("invalid frame name: "), name)).cast("string")
    return F.when(bad, error).otherwise(name)


def _suffix(name: str | Column, directories: bool) -> Column:
    return F.lit("") if directories else F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def _numbered(names: DataFrame, name: str, directories: bool) -> DataFrame:
    """``names`` with ``_parent`` and ``_index`` of those that are a number of another name."""
    shape = r"^(.+)_(\d{3,})()$" if directories else r"^(.+)_(\d{3,})(\.[^.]+)?$"
    found = names.withColumns(
        {
            "_digits": F.regexp_extract(name, shape, 2),
            "_ending": F.regexp_extract(name, shape, 3),
            "_parent": F.concat(F.regexp_extract(name, shape, 1), F.regexp_extract(name, shape, 3)),
        }
    ).where("_digits <> '' and length(_digits) < 18")
    found = found.withColumn("_index", F.col("_digits").cast("long"))
    found = found.where(F.format_string("%03d", F.col("_index")) == F.col("_digits"))
    # a number goes before the suffix, so one behind it belongs to no name
    return found.where(_suffix("_parent", directories) == F.col("_ending")).drop("_digits", "_ending")


def _pieces(order: str) -> Column:
    return F.floor(F.col(order) / 65536).cast("long")


def _claims(start_index: int):
    """Goes along the numbers of each name and finds requested ones that an earlier request takes.

    Rows are sorted by family, length of the parent, parent and index, so a parent that is itself a number
    has been decided before its own numbers come. Only such parents are remembered, family by family.
    """

    def run(batches):
        import pyarrow as pa

        family = parent = None
        claimed: set[str] = set()
        gone = held = 0
        for batch in batches:
            found = []
            for root, above, index, name, there, earlier, asked, matters in zip(
                *[batch.column(c).to_pylist() for c in ("_root", "_parent", "_index", "name", "_there", "_earlier", "_held", "_inner")],
                strict=True,
            ):
                if root != family:
                    family, parent, claimed = root, None, set()
                if above != parent:
                    parent, gone, held = above, 0, int(asked or above in claimed)
                # requests before this one's that need a number, and the place of this number among the free ones
                needing, place = earlier - 1 + held, index - start_index - gone
                taken = there or place >= needing
                gone += taken
                found.append(not taken)
                if not taken and matters:
                    claimed.add(name)
            kept = [i for i, f in enumerate(found) if f]
            yield batch.select(["name"]).take(pa.array(kept, pa.int64()))

    return run


def _claimed(requests: DataFrame, existing: DataFrame, name: str, order: str, start_index: int, directories: bool) -> DataFrame:
    """Requested names that a request of the name they are a number of takes before their own first one."""
    asked = _numbered(requests.select(name, order), name, directories).where(F.col("_index") >= start_index)
    kids = asked.groupBy(F.col(name).alias("name"), "_parent", "_index").agg(F.min(order).cast("long").alias("_first"))
    kids = kids.join(existing.select(F.col(name).alias("name")), "name", "left_anti")
    kids = kids.join(requests.select(F.col(name).alias("_parent")), "_parent", "left_semi")
    there = existing.select(F.col(name).alias("_parent")).distinct().withColumn("_held", F.lit(True))
    kids = kids.join(there, "_parent", "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    kids = cut_lineage(kids)
    if kids.isEmpty():
        return kids.select(F.col("name").alias(name))
    # requests of the parent before the first request of the number: places among both, less places of probes
    parents = kids.select(F.col("_parent").alias(name)).distinct()
    asked = requests.join(parents, name, "left_semi").select(
        F.col(name).alias("_parent"), F.col(order).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("name")
    )
    probes = kids.select("_parent", F.col("_first").alias("_at"), F.lit(0).alias("_kind"), "name")
    both = number_within(asked.unionByName(probes), ["_parent"], ["_at", "_kind"], _pieces("_at"), "_both")
    own = number_within(probes, ["_parent"], ["_at", "_kind"], _pieces("_at"), "_own")
    earlier = both.where("_kind = 0").join(own.select("name", "_own"), "name")
    earlier = earlier.select("name", (F.col("_both") - F.col("_own")).alias("_earlier"))
    conditional = kids.join(earlier, "name").select(
        "_parent", "_index", "name", F.lit(False).alias("_there"), "_earlier", "_held"
    )
    blocked = _numbered(existing.select(name).distinct(), name, directories).where(F.col("_index") >= start_index)
    blocked = blocked.join(kids.select("_parent", "_held").distinct(), "_parent").select(
        "_parent", "_index", F.col(name).alias("name"), F.lit(True).alias("_there"), F.lit(0).cast("long").alias("_earlier"), "_held"
    )
    inner = conditional.select(F.col("_parent").alias("name")).distinct().withColumn("_inner", F.lit(True))
    stem = F.substring(F.col("_parent"), F.lit(1), F.length("_parent") - F.length(_suffix("_parent", directories)))
    rows = conditional.unionByName(blocked).join(inner, "name", "left")
    rows = rows.withColumn("_inner", F.coalesce("_inner", F.lit(False))).withColumn(
        "_root", F.concat(F.regexp_replace(stem, r"(_\d{3,})+$", ""), _suffix("_parent", directories))
    )
    long = F.length("_parent")
    dealt = rows.withColumn("_long", long).repartition("_root").sortWithinPartitions("_root", "_long", "_parent", "_index")
    return cut_lineage(dealt.mapInArrow(_claims(start_index), "name string").select(F.col("name").alias(name)))


def assign_incremental(
    requests: DataFrame,
    existing: DataFrame,
    name: str = "name",
    order: str = "order_id",
    start_index: int = 0,
    directories: bool = False,
) -> DataFrame:
    """Give each request a free name: its own, else with ``_000``, ``_001``, ... before the suffix.

    Numbers begin at ``start_index``. ``directories`` have no suffix: the number ends the name.

    ``order`` is a non-negative integer, different in each request; requests choose one after another in
    that order, each the first name that neither exists nor was given before. So a request for
    ``a_000.jpg`` behind two for ``a.jpg`` becomes ``a_000_000.jpg``, and one before them leaves
    ``a_001.jpg`` to the second. Requests of one name are counted in pieces of 65 536 order values, so one
    very common name does not become one task; requested numbers of a name are gone through in one task,
    a row at a time, once for each distinct name.
    """
    suffix = _suffix(name, directories)
    stem = F.substring(F.col(name), F.lit(1), F.length(name) - F.length(suffix))
    ranked = number_within(requests, [name], [order], _pieces(order), "_rank")
    # The first request gets the bare name unless it is held; the rest need numbers 0, 1, ...
    claimed = _claimed(requests, existing, name, order, start_index, directories)
    held = existing.select(name).union(claimed).distinct().withColumn("_held", F.lit(1))
    want = ranked.join(held, name, "left").withColumn(
        "_need", F.col("_rank") + F.coalesce(F.col("_held"), F.lit(0)) - 1
    ).drop("_rank", "_held")
    # Numbers that are gone: existing ones, and requested ones that their own first request takes.
    asked = requests.select(name).distinct().join(claimed, name, "left_anti")
    gone = _numbered(existing.select(name).union(asked).distinct(), name, directories)
    gone = gone.where(F.col("_index") >= start_index).select(F.col("_parent").alias(name), "_index")
    gone = number_within(gone, [name], ["_index"], _pieces("_index"), "_lower")
    # The k-th of them is passed by the needs from its number less those before it on; so a need's place
    # among both is its number.
    passed = gone.select(
        name, (F.col("_index") - start_index - F.col("_lower")).alias("_need"), F.lit(0).alias("_kind")
    )
    row = F.struct(*[F.col(f"`{c}`") for c in requests.columns])
    rows = want.where("_need >= 0").select(name, "_need", F.lit(1).alias("_kind"), row.alias("_row"))
    passed = passed.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType))
    placed = number_within(rows.unionByName(passed), [name], ["_need", "_kind"], _pieces("_need"), "_place").where("_kind = 1")
    number = F.format_string("%03d", F.col("_place") + start_index)
    given = placed.select("_row.*", F.col("_place")).select(
        *[F.col(f"`{c}`") for c in requests.columns], F.concat(stem, F.lit("_"), number, suffix).alias("assigned")
    )
    bare = want.where("_need < 0").select(*[F.col(f"`{c}`") for c in requests.columns], F.col(name).alias("assigned"))
    return bare.unionByName(given)
