"""URL filters: host and path rules, and boosted trees on lexical features, all as expressions."""

from __future__ import annotations

import string

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.tables import stored

#: Words that mark a host wherever they stand in it, by kinds as published block lists have them; the
#: labels of this library's own queries.
MARKED = {
    "adult": "adult xxx porn hentai camgirl nudes onlyfans",
    "advertising": "adserv adclick adsense adtech adnetwork advertis doubleclick popunder clickbait",
    "betting": "sportsbet betting bookmaker bookie sportsbook",
    "drugs": "pills pharma viagra steroids xanax tramadol cannabis cocaine kratom vicodin",
    "fraud": "spam malware phish warez ransomware spyware keygen torrent ponzi getrich freemoney payday",
    "gambling": "casino gambl jackpot roulette blackjack baccarat poker lottery slotmachine freespin",
    "tracking": "tracker tracking webstat analytics telemetry hitcount fingerprintjs",
}

#: Words that mark a host as a whole token only (between signs, digits and dots); as parts of others they
#: say nothing. ``ad`` is also a country's last label, where it does not count.
MARKED_TOKENS = {
    "adult": "sex sexy nude cams fetish escort escorts erotic milf",
    "advertising": r"ads ad(?=[^\p{L}]) adv advert adverts sponsor sponsored popup popups banner banners",
    "betting": "bet bets odds wager wagers",
    "drugs": "pill drugs drug meds rx weed opioids cialis",
    "fraud": "crack cracks cracked hack hacks fraud fake counterfeit replica virus trojan scam scams",
    "gambling": "slot slots bingo lotto keno spins",
    "tracking": "track tracks trk pixel beacon beacons counter metrics stats",
}

LEXICAL = (
    "n_chars host_chars n_labels path_depth digit_share host_digit_share host_entropy n_params "
    "n_hyphens longest_label secure"
).split()
SUFFIXES = (1, 2, 3)
FEATURES = [*LEXICAL, *[f"suffix{n}_{k}" for n in SUFFIXES for k in ("share", "seen")]]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lowered, and the
    path from there up to ``?``, ``#`` or the end. Both are empty for a null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    before = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.substring_index(before, "/", 1)
    path = F.substr(before, F.length(host) + 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does.

    ``rules`` are ``(verdict, host/path)``. A rule fits its host and all subdomains if the path
    starts with the rule's. The list becomes one expression, so it is for some hundred rules.
    """
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def with_features(df: DataFrame) -> DataFrame:
    """``df`` (with ``url, host, path``) and its lexical features."""
    url, host = F.coalesce("url", F.lit("")), F.col("host")
    n = F.greatest(F.length(host), F.lit(1))
    entropy = F.lit(0.0)
    for sign in string.ascii_lowercase + string.digits + "-.":
        share = _count(host, sign) / n
        entropy = entropy - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    query = F.when(F.instr(url, "?") > 0, F.substr(url, F.instr(url, "?") + 1)).otherwise(F.lit(""))
    query = F.substring_index(query, "#", 1)
    labels = F.split(host, r"\.")
    made = {
        "n_chars": F.length(url),
        "host_chars": F.length(host),
        "n_labels": F.when(host == "", 0).otherwise(F.size(labels)),
        "path_depth": _count(F.col("path"), "/"),
        "digit_share": _count(url, string.digits) / F.greatest(F.length(url), F.lit(1)),
        "host_digit_share": _count(host, string.digits) / n,
        "host_entropy": entropy,
        "n_params": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "n_hyphens": _count(host, "-"),
        "longest_label": F.array_max(F.transform(labels, F.length)),
        "secure": F.lower(F.substr(url, F.lit(1), F.lit(6))) == "https:",
    }
    return df.withColumns({k: v.cast("double") for k, v in made.items()})


def host_suffixes(df: DataFrame) -> DataFrame:
    return df.withColumns({f"suffix{k}": F.substring_index("host", ".", -k) for k in SUFFIXES})


def suffix_statistics(labelled: DataFrame, n: int) -> DataFrame:
    """Share of blocked URLs (drawn to the middle by two rows) and log count by host suffix."""
    seen = F.count("*")
    return labelled.groupBy(f"suffix{n}").agg(
        ((F.sum("label") + 1) / (seen + 2)).alias(f"suffix{n}_share"),
        F.log1p(seen).alias(f"suffix{n}_seen"),
    )


def with_suffixes(df: DataFrame, statistics: dict[int, DataFrame]) -> DataFrame:
    """``df`` (with ``host``) with its suffixes and their statistics; an unseen suffix is undecided. The
    tables grow with the hosts, so how they are joined is left to adaptive execution."""
    df = host_suffixes(df)
    for n, table in statistics.items():
        df = df.join(table, f"suffix{n}", "left")
    return df.fillna({f"suffix{n}_share": 0.5 for n in statistics} | {f"suffix{n}_seen": 0.0 for n in statistics})


def train(labelled: DataFrame, most: int = 5_000, trees: int = 8, depth: int = 3) -> tuple[PipelineModel | None, dict[int, DataFrame]]:
    """Trees and suffix tables from ``labelled`` (url, host, path, label 0 or 1).

    The trees are fitted to at most ``most`` distinct URLs: those with the smallest hashes of one half of
    all, by another hash. Suffix tables cover all distinct labelled URLs; those for fitting leave out
    the URLs fitted to, so that the trees see suffixes as they will be in new URLs. With labels of one
    kind only there are no trees.
    """
    known = stored(
        labelled.where("url IS NOT NULL AND label IS NOT NULL")
        .groupBy("url", "host", "path")
        .agg(F.max("label").cast("double").alias("label")),
        "labelled-urls",
    )
    half = F.pmod(F.xxhash64(F.lit("half"), F.col("url")), F.lit(2)) == 0
    place = F.struct(F.xxhash64("url").alias("hash"), "url")
    sample = known.where(~half).orderBy(place).limit(most).cache()
    last = sample.agg(F.max(place).alias("last")).first()["last"]
    others = known
    if last is not None:
        others = known.where(half | (place > F.struct(F.lit(last["hash"]), F.lit(last["url"]))))
    others, statistics = host_suffixes(others), {}
    for n in SUFFIXES:
        wanted = host_suffixes(sample).select(f"suffix{n}").distinct()  # at most ``most`` rows
        statistics[n] = suffix_statistics(others.join(F.broadcast(wanted), f"suffix{n}", "left_semi"), n)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
        with_features(with_suffixes(sample, statistics))
    )
    rows = rows.select("features", "label").coalesce(1).cache()
    whole = host_suffixes(known)
    tables = {n: suffix_statistics(whole, n) for n in SUFFIXES}
    if rows.select("label").distinct().count() < 2:
        return None, tables
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, seed=1, maxBins=32).fit(rows)
    model = PipelineModel([VectorAssembler(inputCols=FEATURES, outputCol="features"), boosted])
    return model, tables


def score(df: DataFrame, model: PipelineModel | None, statistics: dict[int, DataFrame]) -> DataFrame:
    """``df`` (url, host, path and columns to keep) with ``blocked``, the probability of a block."""
    kept = df.columns
    found = with_features(with_suffixes(df, statistics))
    if model is None:
        return found.select(*kept, F.lit(0.0).alias("blocked"))
    found = model.transform(found)
    return found.select(*kept, F.get(vector_to_array("probability"), F.lit(1)).alias("blocked"))


def weak_labels(
    df: DataFrame, words: dict[str, str] = MARKED, tokens: dict[str, str] = MARKED_TOKENS
) -> DataFrame:
    """``df`` with ``label``: 1 where a marked word is part of the host, or a marked token one of its tokens."""
    parts = "|".join(" ".join(words.values()).split())
    whole = "|".join(" ".join(tokens.values()).split())
    marked = F.col("host").rlike(rf"{parts}|(?:^|[^\p{{L}}])(?:{whole})(?:$|[^\p{{L}}])")
    return df.withColumn("label", marked.cast("int"))


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    model: PipelineModel | None,
    statistics: dict[int, DataFrame],
    threshold: float = 0.5,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, blocked`` of each row of ``pages``.

    A fitting rule decides, else the trees. A null url has an empty host and path, no rule, and is
    scored as an empty string. Repeated rows stay; other columns of ``pages`` are not read.
    """
    host, path = host_and_path(F.col("url"))
    scored = score(pages.select("page_id", "url", host.alias("host"), path.alias("path")), model, statistics)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    by_trees = F.when(F.col("blocked") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_trees).alias("verdict"), "blocked"
    )
