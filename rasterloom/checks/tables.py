"""Queries and SQL checks: frames, videos, names, inventories and comparisons."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.checks import sql
from rasterloom.checks.pointwise import colour
from rasterloom.functions import naming
from rasterloom.model import to_pixels
from rasterloom.operators import blocks, frames, inventory, lines, pixelwise, quality

ORIGIN = 1704067200  # 2024-01-01 in seconds
HOUR = 3600.0
NOW = datetime(2001, 8, 1)
#: What stands before the suffix of requested names; a number may be asked for before or after it is given.
NAME_TAILS = ["", "_000", "", "_001", "_000_000", "", "_002", "_000", "_0001", "_001_000", "", "_004", "_000"]
SLOTS = {"fps": 1 / HOUR, "tie": "event_id"}


def frame_table(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames: a user is a video, an event a frame, seconds of 2024 its time."""
    events = spark.read.parquet(f"{d}/events.parquet")
    at = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
    pts = (F.unix_micros(at) - ORIGIN * 1_000_000) / 1e6
    return events.select(F.col("user_id").alias("video_id"), "event_id", pts.alias("pts"))


def video_table(spark: SparkSession, d: str) -> DataFrame:
    """Orders as videos."""
    key = F.col("o_orderkey")
    known = key % 7 != 0
    return spark.read.parquet(f"{d}/orders.parquet").select(
        key.alias("video_id"),
        F.col("o_totalprice").alias("duration"),
        F.when(known, (key % 5) * 320).cast("int").alias("width"),
        F.when(known, (key % 4) * 270).cast("int").alias("height"),
        F.when(known, (key % 3) * 15.0).alias("fps"),
    )


def raw_videos(spark: SparkSession, d: str) -> DataFrame:
    """Orders as raw download metadata, with gaps."""
    key = F.col("o_orderkey")

    def some(n: int, value):
        return F.when(key % n != 0, value)

    return spark.read.parquet(f"{d}/orders.parquet").select(
        some(5, key.cast("string")).alias("id"),
        some(4, F.col("o_orderpriority")).alias("title"),
        some(3, F.col("o_totalprice")).alias("duration"),
        some(7, (key % 1920).cast("int")).alias("width"),
        some(7, (key % 1080).cast("int")).alias("height"),
        some(6, F.lit(25.0)).alias("fps"),
        some(2, F.lit("webm")).alias("ext"),
        some(8, key % 3 * 1000).alias("filesize"),
        some(9, key * 2).alias("filesize_approx"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("upload_date"),
        some(11, F.concat(F.lit("/videos/"), key, F.lit(".mp4"))).alias("file_path"),
    )


def format_table(spark: SparkSession, d: str) -> DataFrame:
    """Line items as the formats of an order's video."""
    return spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_orderkey").alias("video_id"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("format_id"),
        (F.col("l_linenumber") * 240).alias("height"),
        F.when(F.col("l_returnflag") == "A", "mp4")
        .when(F.col("l_returnflag") == "N", "webm")
        .otherwise("mkv")
        .alias("ext"),
    )


def file_table(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(
        F.concat(F.lit("/cache/"), F.col("o_orderkey")).alias("path"),
        F.col("o_orderdate").alias("modificationTime"),
        (F.col("o_totalprice") * 1000).cast("long").alias("length"),
    )


def numbered(spark: SparkSession, d: str) -> DataFrame:
    return frames.number_frames(frame_table(spark, d), "event_id", part_seconds=86400.0)


def picked(quality_name: str, container: str):
    return lambda spark, d: frames.pick_format(format_table(spark, d), quality_name, container)


def picked_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Formats with text ids, many of equal height."""
    named = format_table(spark, d).withColumns(
        {"format_id": F.concat("ext", F.lit("-"), F.col("format_id") % 7, F.lit("p")), "height": F.col("height") % 480}
    )
    return frames.pick_format(named, "720p", "webm")


def name_requests(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(
        F.concat("source", F.lit(".jpg")).alias("name"), F.col("doc_id").alias("order_id")
    )


def dependent_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests for names that are numbers of names requested before or after them."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    tails = F.array(*[F.lit(t) for t in NAME_TAILS])
    tail = F.element_at(tails, (F.col("doc_id") * 7 % len(NAME_TAILS) + 1).cast("int"))
    asked = docs.select(F.concat("source", tail, F.lit(".jpg")).alias("name"), F.col("doc_id").alias("order_id"))
    there = docs.where("doc_id % 11 = 3").select(F.format_string("%s_%03d.jpg", "source", F.col("doc_id") % 9).alias("name"))
    return naming.assign_incremental(asked, there)


def numbered_directories(spark: SparkSession, d: str) -> DataFrame:
    """Directory names, some with dots, beside those that exist."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    asked = docs.select(F.concat("source", F.lit(".d")).alias("name"), F.col("doc_id").alias("order_id"))
    taken = docs.where("doc_id % 4 = 1").select(
        F.format_string("%s.d_%03d", "source", F.col("doc_id") % 90).alias("name")
    )
    return naming.assign_incremental(asked, taken, start_index=3, directories=True)


def names_taken(spark: SparkSession, d: str) -> DataFrame:
    """Names that exist: some plain, some numbered, some that only look numbered."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(
        F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit(".jpg")))
        .when(F.col("doc_id") % 3 == 1, F.format_string("%s_%03d.jpg", "source", F.col("doc_id") % 50))
        .otherwise(F.format_string("%s_%02d.jpg", "source", F.col("doc_id") % 50))
        .alias("name")
    )


def named_frames(spark: SparkSession, d: str) -> DataFrame:
    rows = numbered(spark, d)
    pattern = "{video_id}-{index:04d}-{timestamp:.2f}.{ext}"
    return rows.select(
        "event_id",
        naming.frame_name(F.col("video_id"), F.col("frame_no")).alias("plain"),
        naming.frame_name(
            F.concat(F.lit("a:b/"), F.col("video_id")), F.col("frame_no"), F.col("pts"), "png", pattern
        ).alias("custom"),
        naming.frame_name(
            F.col("video_id"), F.col("frame_no"), pattern="{video_id}_{nothing}.{ext}"
        ).alias("fallback"),
    )


def step_names(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select(
        "page_id",
        naming.clean_step_name(F.col("url")).alias("step"),
        naming.output_name(
            naming.output_name(F.concat(naming.sanitize_name("url"), F.lit(".v1.jpg")), "blur", 0),
            "boost",
            11,
        ).alias("file"),
    )


def safe_names(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    pages = spark.read.parquet(f"{d}/pages.parquet")
    texts = docs.select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), F.col("text").alias("t"))
    return texts.unionAll(
        pages.select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), F.col("html").alias("t"))
    ).select("id", "kind", naming.sanitize_name("t").alias("name"))


def compared(spark: SparkSession, d: str) -> DataFrame:
    """A raster beside its heavily gapped form."""
    scan = colour(spark, d)
    return quality.compare(scan, lines.slc_off(scan, gap_width=0.4, scan_period=9, fill_mode="white"))


def compared_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixel tables, one of them without the lines a filter removed."""
    px = to_pixels(colour(spark, d))
    other = pixelwise.noise(px, mode="row", amount=0.1, seed=9).where("(y + frame_id) % 10 <> 3")
    return quality.compare(px, other)


def statistics(spark: SparkSession, d: str) -> DataFrame:
    scan = lines.slc_off(colour(spark, d), gap_width=0.5, scan_period=8, fill_mode="black")
    return quality.frame_stats(scan)


def step_summary(spark: SparkSession, d: str) -> DataFrame:
    scan = colour(spark, d)
    return quality.summarize(
        {"source": scan, "muted": pixelwise.saturation(scan, mode="fixed", value=-0.5),
         "squeezed": blocks.compression(scan, quality=30)}
    )


def lines_missing(spark: SparkSession, d: str) -> DataFrame:
    """Frames are counted whatever lines they have."""
    scan = colour(spark, d)
    return quality.summarize({"tail": scan.where("y > 0"), "some": scan.where("y > 3 AND frame_id % 2 = 0"),
                              "pixels": to_pixels(scan).where("x > 9")})


def expected(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/lineitem.parquet").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("start"),
        (F.col("l_quantity") + F.col("l_extendedprice") / 1000.0).alias("end"),
        (F.col("l_linenumber") / 8.0).alias("interval"),
    )
    counted = frames.expected_frames(items)
    return counted.groupBy("l_linenumber").agg(
        F.count("*").alias("segments"), F.sum("expected_frames").alias("expected_frames")
    )


def normalized(spark: SparkSession, d: str) -> DataFrame:
    """Nullable integers are shown as text, so that both engines print them alike."""
    text = {c: F.col(c).cast("string") for c in ("width", "height", "file_size")}
    return frames.normalize_videos(raw_videos(spark, d)).withColumns(text)


def retention(spark: SparkSession, d: str) -> DataFrame:
    keep, expire = inventory.split_retention(file_table(spark, d), NOW, 400)
    return (
        keep.withColumn("state", F.lit("keep"))
        .unionAll(expire.withColumn("state", F.lit("expire")))
        .select("path", "length", "state")
    )


def policies(spark: SparkSession, d: str) -> DataFrame:
    files = file_table(spark, d)
    parts = [
        inventory.apply_policy(files, policy, phase, NOW, 400)
        .agg(F.count("*").alias("files"))
        .select(F.lit(policy).alias("policy"), F.lit(phase).alias("phase"), "files")
        for policy in inventory.POLICIES
        for phase in ("start", "end")
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole


def queries() -> dict:
    return {
        "f1_segment": lambda spark, d: frames.segment(frame_table(spark, d), 86400.0, 10 * 86400.0),
        "f2_sample_fps": lambda spark, d: frames.sample_fps(frame_table(spark, d), **SLOTS),
        "f3_sample_interval": lambda spark, d: frames.sample_every_seconds(
            frames.segment(frame_table(spark, d), 7 * 86400.0), 21600.0, time="t", tie="event_id"
        ),
        "f4_sample_nth": lambda spark, d: frames.sample_nth(numbered(spark, d), 5),
        "f6_estimate_fps": lambda spark, d: frames.estimate_frames(video_table(spark, d), fps=1.5)
        .select("video_id", "estimated_frames"),
        "f6_estimate_interval": lambda spark, d: frames.estimate_frames(
            video_table(spark, d), frame_interval=7
        ).select("video_id", "estimated_frames"),
        "f7_resolution": lambda spark, d: frames.with_resolution(video_table(spark, d)).select(
            "video_id", "resolution"
        ),
        "f8_duration_str": lambda spark, d: frames.with_duration_str(video_table(spark, d)).select(
            "video_id", "duration_str"
        ),
        "f9_normalize_videos": normalized,
        "f10_pick_best": picked("best", "mp4"),
        "f10_pick_worst": picked("worst", "webm"),
        "f10_pick_720p": picked("720p", "mkv"),
        "f10_pick_text_ids": picked_by_name,
        "s4_s7_step_names": step_names,
        "s5_frame_name": named_frames,
        "s6_sanitize_name": safe_names,
        "s8_assign_incremental": lambda spark, d: naming.assign_incremental(
            name_requests(spark, d), names_taken(spark, d)
        ),
        "s8_start_index": lambda spark, d: naming.assign_incremental(
            name_requests(spark, d), names_taken(spark, d), start_index=5
        ),
        "s8_directories": numbered_directories,
        "s8_dependent_requests": dependent_requests,
        "i1_inventory_size": lambda spark, d: inventory.inventory_size(file_table(spark, d)),
        "i2_check_size": lambda spark, d: inventory.check_size(
            file_table(spark, d), max_size_gb=1.0, strict=False
        ),
        "i3_retention": retention,
        "i4_clear_policy": policies,
        "x5_compare": compared,
        "x5_compare_missing": compared_pixels,
        "x6_frame_stats": statistics,
        "x7_step_summary": step_summary,
        "x7_missing_lines": lines_missing,
        "x8_expected_frames": expected,
    }


FRAMES = f"""
frames AS (SELECT user_id AS video_id, event_id,
  (epoch_us(ts)-{ORIGIN}000000)::DOUBLE/1000000.0::DOUBLE AS pts FROM events)"""
VIDEOS = """
videos AS (SELECT o_orderkey AS video_id, o_totalprice AS duration,
  CASE WHEN o_orderkey%7<>0 THEN (o_orderkey%5*320)::INT END AS width,
  CASE WHEN o_orderkey%7<>0 THEN (o_orderkey%4*270)::INT END AS height,
  CASE WHEN o_orderkey%7<>0 THEN (o_orderkey%3)*15.0::DOUBLE END AS fps FROM orders)"""
FORMATS = """
formats AS (SELECT l_orderkey AS video_id, l_partkey*100000+l_suppkey AS format_id,
  l_linenumber*240 AS height,
  CASE l_returnflag WHEN 'A' THEN 'mp4' WHEN 'N' THEN 'webm' ELSE 'mkv' END AS ext FROM lineitem)"""


def _slots(source: str, rate: str, time: str, columns: str) -> str:
    """Every slot of the grid takes the latest frame at or before it."""
    return f"""
s AS (SELECT *, floor({time}*{rate}+0.5::DOUBLE)::BIGINT AS k FROM {source}),
last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY video_id, k ORDER BY {time} DESC, event_id DESC)=1),
grid AS (SELECT video_id, unnest(range(lo, hi+1))::BIGINT AS slot FROM
  (SELECT video_id, min(k) AS lo, max(k) AS hi FROM last GROUP BY video_id))
SELECT g.video_id, g.slot, {columns} FROM grid g ASOF JOIN last l ON l.video_id=g.video_id AND g.slot>=l.k"""


def _pick(order: str, container: str) -> str:
    return f"""
WITH {FORMATS}
SELECT video_id, format_id, height, ext FROM formats
QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY {order.format(c=container)}, format_id, ext)=1"""


def _sanitized(c: str) -> str:
    return f"""trim(regexp_replace(regexp_replace(regexp_replace({c},'[<>:"/\\\\|?*]','_','g'),'[\\x00-\\x1f\\x7f]','','g'),'__+','_','g'),'. ')"""


def _safe_names() -> str:
    return f"""
WITH t AS (SELECT doc_id AS id, 'document' AS kind, {_sanitized('text')} AS s FROM documents
  UNION ALL SELECT page_id, 'page', {_sanitized('html')} FROM pages),
p AS (SELECT *, CASE WHEN contains(s,'.') THEN reverse(split_part(reverse(s),'.',1)) ELSE '' END AS ext FROM t),
q AS (SELECT *, left(s, (length(s)-length(ext)-1)::BIGINT) AS stem FROM p)
SELECT id, kind, CASE WHEN s='' THEN 'unnamed' WHEN length(s)<=255 THEN s
  WHEN ext='' THEN left(s,255)
  WHEN 254-length(ext)>=0 THEN left(stem,254-length(ext))||'.'||ext
  ELSE left(stem,greatest(0,length(stem)+254-length(ext)))||'.'||ext END AS name FROM q"""


def _incremental(start: int = 0) -> str:
    """Free numbers are listed per name and dealt out in order."""
    return f"""
WITH req AS (SELECT source||'.jpg' AS name, source AS stem, doc_id AS order_id FROM documents),
taken AS (
  SELECT DISTINCT CASE doc_id%3 WHEN 0 THEN source||'.jpg'
    WHEN 1 THEN printf('%s_%03d.jpg',source,doc_id%50) ELSE printf('%s_%02d.jpg',source,doc_id%50) END AS name
  FROM documents),
ranked AS (SELECT r.*, row_number() OVER (PARTITION BY r.name ORDER BY order_id)-1
    -CASE WHEN t.name IS NULL THEN 1 ELSE 0 END AS need
  FROM req r LEFT JOIN taken t ON t.name=r.name),
cand AS (SELECT name, stem, unnest(range({start},n+50+{start})) AS i FROM (SELECT name, stem, count(*) AS n FROM req GROUP BY ALL)),
free AS (SELECT c.name, printf('%s_%03d.jpg',c.stem,i) AS assigned, row_number() OVER (PARTITION BY c.name ORDER BY i)-1 AS need
  FROM cand c LEFT JOIN taken t ON t.name=printf('%s_%03d.jpg',c.stem,i) WHERE t.name IS NULL)
SELECT r.name, r.order_id, coalesce(f.assigned, r.name) AS assigned
FROM ranked r LEFT JOIN free f ON f.name=r.name AND f.need=r.need"""


def _compare_sql(right: str) -> str:
    """`right(frame_id, y, x, r, g, b)` beside px."""
    return f"""
both_sides AS (SELECT coalesce(p.frame_id,q.frame_id) AS frame_id, (p.r IS NULL OR q.r IS NULL) AS gone,
    abs(p.r-q.r) AS dr, abs(p.g-q.g) AS dg, abs(p.b-q.b) AS db
  FROM px p FULL JOIN {right} q ON q.frame_id=p.frame_id AND q.y=p.y AND q.x=p.x),
d AS (SELECT frame_id, dr AS v FROM both_sides UNION ALL SELECT frame_id, dg FROM both_sides UNION ALL SELECT frame_id, db FROM both_sides),
m AS (SELECT frame_id, count(v) AS samples, max(v)::INT AS max_diff,
    sum(v)::BIGINT::DOUBLE/count(v) AS mean_diff,
    sqrt((count(v)::HUGEINT*sum(v*v)-sum(v)::HUGEINT*sum(v))::DOUBLE)/count(v) AS std_diff,
    quantile_cont(v,0.5) AS median_diff, quantile_cont(v,0.95) AS p95_diff, quantile_cont(v,0.99) AS p99_diff,
    CASE WHEN sum(v*v)>0 THEN 10.0::DOUBLE*log10(65025.0::DOUBLE/(sum(v*v)::BIGINT::DOUBLE/count(v))) END AS psnr
  FROM d GROUP BY frame_id),
c AS (SELECT frame_id, count(*) FILTER (gone) AS missing_pixels, count(*) FILTER (dr+dg+db>0) AS changed_pixels
  FROM both_sides GROUP BY frame_id)
SELECT m.*, c.missing_pixels, c.changed_pixels FROM m JOIN c USING (frame_id)"""


def oracles() -> dict[str, str]:
    from rasterloom.checks.pointwise import _gap_ctes, _noise

    gap9 = f"""
gapped AS (SELECT px.frame_id, px.y, x, CASE WHEN x>=gap_from AND x<gap_to THEN 255 ELSE r END AS r,
  CASE WHEN x>=gap_from AND x<gap_to THEN 255 ELSE g END AS g, CASE WHEN x>=gap_from AND x<gap_to THEN 255 ELSE b END AS b
  FROM px LEFT JOIN mask ON mask.frame_id=px.frame_id AND mask.y=px.y)"""
    black = gap9.replace("THEN 255", "THEN 0")
    row = sql.uniform(9, "row", "y", "{i}")
    noisy = _noise(f"({row}*2.0::DOUBLE-1.0::DOUBLE)*{0.1 * 255.0!r}::DOUBLE", "rgb")
    stats = ", ".join(
        f"sum({b})::BIGINT AS sum_{b}, min({b}) AS min_{b}, max({b}) AS max_{b}, count(DISTINCT {b})::INT AS distinct_{b}"
        for b in "rgb"
    )
    key = "o_orderkey"
    within = "height<=720"
    return {
        "f1_segment": f"WITH {FRAMES} SELECT *, pts-86400.0::DOUBLE AS t FROM frames WHERE pts>=86400 AND pts<864000",
        "f2_sample_fps": f"WITH {FRAMES}, "
        + _slots("frames", f"{1 / HOUR!r}::DOUBLE", "pts", "l.pts, l.event_id"),
        "f3_sample_interval": f"WITH {FRAMES}, seg AS (SELECT *, pts-604800.0::DOUBLE AS t FROM frames WHERE pts>=604800), "
        + _slots("seg", f"{1 / 21600.0!r}::DOUBLE", "t", "l.t, l.event_id, l.pts"),
        "f4_sample_nth": f"""WITH {FRAMES}, n AS (SELECT *,
  (row_number() OVER (PARTITION BY video_id ORDER BY pts, event_id)-1)::BIGINT AS frame_no FROM frames)
SELECT * FROM n WHERE frame_no%5=0""",
        "f6_estimate_fps": f"WITH {VIDEOS} SELECT video_id, trunc(duration*1.5::DOUBLE)::BIGINT AS estimated_frames FROM videos",
        "f6_estimate_interval": f"WITH {VIDEOS} SELECT video_id, trunc(duration*CASE WHEN fps IS NULL OR fps=0 THEN 30.0::DOUBLE ELSE fps END)::BIGINT//7 AS estimated_frames FROM videos",
        "f7_resolution": f"WITH {VIDEOS} SELECT video_id, CASE WHEN width>0 AND height>0 THEN width||'x'||height END AS resolution FROM videos",
        "f8_duration_str": f"""WITH {VIDEOS}, s AS (SELECT video_id, trunc(duration)::BIGINT AS s FROM videos)
SELECT video_id, printf('%02d:%02d:%02d', s//3600, s//60%60, s%60) AS duration_str FROM s""",
        "f9_normalize_videos": f"""
SELECT CASE WHEN {key}%5=0 THEN 'unknown' ELSE {key}::VARCHAR END AS video_id,
  CASE WHEN {key}%4=0 THEN 'Unknown' ELSE o_orderpriority END AS title,
  CASE WHEN {key}%3=0 THEN 0.0::DOUBLE ELSE o_totalprice END AS duration,
  CASE WHEN {key}%7<>0 THEN ({key}%1920)::VARCHAR END AS width,
  CASE WHEN {key}%7<>0 THEN ({key}%1080)::VARCHAR END AS height,
  CASE WHEN {key}%6<>0 THEN 25.0::DOUBLE END AS fps,
  CASE WHEN {key}%2=0 THEN 'mp4' ELSE 'webm' END AS format,
  CASE WHEN {key}%8<>0 AND {key}%3<>0 THEN ({key}%3*1000)::VARCHAR WHEN {key}%9<>0 THEN ({key}*2)::VARCHAR END AS file_size,
  NULL::VARCHAR AS thumbnail_url, NULL::VARCHAR AS uploader, strftime(o_orderdate,'%Y%m%d') AS upload_date,
  CASE WHEN {key}%11<>0 THEN '/videos/'||{key}||'.mp4' END AS file_path
FROM orders""",
        "f10_pick_best": _pick("(ext='{c}') DESC, height DESC", "mp4"),
        "f10_pick_worst": _pick("(ext='{c}') DESC, height", "webm"),
        "f10_pick_720p": _pick(
            f"({within} AND ext='{{c}}') DESC, ({within}) DESC, height DESC", "mkv"
        ),
        "f10_pick_text_ids": f"""
WITH {FORMATS}, n AS (SELECT video_id, ext||'-'||(format_id%7)||'p' AS format_id, height%480 AS height, ext FROM formats)
SELECT video_id, format_id, height, ext FROM n
QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY (ext='webm') DESC, height DESC, format_id, ext)=1""",
        "s4_s7_step_names": f"""
SELECT page_id, trim(regexp_replace(url,'[^\\p{{L}}\\p{{N}}_ -]','','g')) AS step,
  'boost_blur_'||{_sanitized('url')}||'.v1_step00_step11.jpg' AS file FROM pages""",
        "s5_frame_name": f"""WITH {FRAMES}, n AS (SELECT *,
  row_number() OVER (PARTITION BY video_id ORDER BY pts, event_id)-1 AS i FROM frames)
SELECT event_id, printf('%d_frame_%06d.jpg',video_id,i) AS plain, printf('a_b_%d-%04d-%.2f.png',video_id,i,pts) AS custom,
  printf('%d_frame_%06d.jpg',video_id,i) AS fallback FROM n""",
        "s6_sanitize_name": _safe_names(),
        "s8_assign_incremental": _incremental(),
        "s8_start_index": _incremental(5),
        "s8_dependent_requests": f"""
WITH RECURSIVE req AS (SELECT source, doc_id, source||([{', '.join(f"'{t}'" for t in NAME_TAILS)}])[doc_id*7%{len(NAME_TAILS)}+1] AS stem,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
run AS (SELECT r.source, 0::BIGINT AS n, coalesce(list(DISTINCT printf('%s_%03d.jpg',d.source,d.doc_id%9)) FILTER (d.source IS NOT NULL), []) AS taken, NULL::VARCHAR AS assigned
  FROM (SELECT DISTINCT source FROM documents) r LEFT JOIN documents d ON d.source=r.source AND d.doc_id%11=3 GROUP BY r.source
  UNION ALL SELECT source, n, list_append(taken, given), given FROM (
    SELECT r.source, q.n, r.taken, CASE WHEN NOT list_contains(r.taken, q.stem||'.jpg') THEN q.stem||'.jpg'
      ELSE list_filter(list_transform(range(0, len(r.taken)+1), lambda i: printf('%s_%03d.jpg', q.stem, i)),
        lambda x: NOT list_contains(r.taken, x))[1] END AS given
    FROM run r JOIN req q ON q.source=r.source AND q.n=r.n+1))
SELECT q.stem||'.jpg' AS name, q.doc_id AS order_id, run.assigned FROM run JOIN req q USING (source, n)""",
        "s8_directories": """
WITH req AS (SELECT source||'.d' AS name, doc_id AS order_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)-2 AS need FROM documents),
taken AS (SELECT DISTINCT printf('%s.d_%03d',source,doc_id%90) AS name FROM documents WHERE doc_id%4=1),
free AS (SELECT n.name, printf('%s_%03d',n.name,i) AS assigned, row_number() OVER (PARTITION BY n.name ORDER BY i)-1 AS need
  FROM (SELECT name, unnest(range(3,count(*)+100)) AS i FROM req GROUP BY name) n
  LEFT JOIN taken t ON t.name=printf('%s_%03d',n.name,i) WHERE t.name IS NULL)
SELECT r.name, r.order_id, coalesce(f.assigned, r.name) AS assigned FROM req r LEFT JOIN free f ON f.name=r.name AND f.need=r.need""",
        "i1_inventory_size": "SELECT sum(trunc(o_totalprice*1000)::BIGINT)::BIGINT AS bytes, sum(trunc(o_totalprice*1000)::BIGINT)::BIGINT/1073741824.0::DOUBLE AS size_gb FROM orders",
        "i2_check_size": "SELECT b AS bytes, b/1073741824.0::DOUBLE AS size_gb, CASE WHEN b/1073741824.0::DOUBLE>1.0 THEN 0 ELSE 1 END AS within_limit FROM (SELECT sum(trunc(o_totalprice*1000)::BIGINT)::BIGINT AS b FROM orders)",
        "i3_retention": "SELECT '/cache/'||o_orderkey AS path, trunc(o_totalprice*1000)::BIGINT AS length, CASE WHEN o_orderdate<TIMESTAMP '2001-08-01'-INTERVAL 400 DAY THEN 'expire' ELSE 'keep' END AS state FROM orders",
        "i4_clear_policy": """
WITH f AS (SELECT count(*) AS n, count(*) FILTER (o_orderdate>=TIMESTAMP '2001-08-01'-INTERVAL 400 DAY) AS k FROM orders)
SELECT policy, phase, CASE WHEN policy='on_start' AND phase='start' THEN 0 WHEN policy='on_exit' AND phase='end' THEN 0
  WHEN phase='start' THEN n ELSE k END::BIGINT AS files
FROM f, (VALUES ('on_start'),('on_exit'),('manual'),('never')) p(policy), (VALUES ('start'),('end')) q(phase)""",
        "x5_compare": f"WITH {sql.PX}, {_gap_ctes(0.4, 9)}, {gap9}, {_compare_sql('gapped')}",
        "x5_compare_missing": f"WITH {sql.PX}, noisy AS (SELECT frame_id, y, x, {noisy} FROM px WHERE (y+frame_id)%10<>3), {_compare_sql('noisy')}",
        "x6_frame_stats": f"""WITH {sql.PX}, {_gap_ctes(0.5, 8)}, {black}
SELECT frame_id, count(*) AS pixels, count(*) FILTER (r=0 AND g=0 AND b=0) AS black_pixels,
  count(*) FILTER (r=255 AND g=255 AND b=255) AS white_pixels, {stats} FROM gapped GROUP BY frame_id""",
        "x7_step_summary": f"WITH {sql.PX} SELECT k AS step_no, s AS step, (SELECT count(*) FROM fr) AS images FROM (VALUES (0,'source'),(1,'muted'),(2,'squeezed')) t(k,s)",
        "x7_missing_lines": f"""WITH {sql.PX} SELECT k AS step_no, s AS step,
  (SELECT count(*) FROM fr WHERE k<>1 OR frame_id%2=0) AS images FROM (VALUES (0,'tail'),(1,'some'),(2,'pixels')) t(k,s)""",
        "x8_expected_frames": """SELECT l_linenumber, count(*) AS segments,
  sum(floor(((l_quantity+l_extendedprice/1000.0::DOUBLE)-l_quantity)/(l_linenumber/8.0::DOUBLE))::BIGINT)::BIGINT AS expected_frames
FROM lineitem GROUP BY l_linenumber""",
    }
