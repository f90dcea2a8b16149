"""Symbol discovery: directories, search, ranking, movers, quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The groups of markets, in the order of display.
GROUPS = ("crypto", "equity", "sim")
EQUITY_MARKETS = ("equity", "stock", "us-equity")


def venue_of(market: Column) -> Column:
    return F.lower(F.substring_index(market, "-", 1))


def market_group(market: Column) -> Column:
    m = F.lower(market)
    return F.when(m == "sim", "sim").when(m.isin(*EQUITY_MARKETS), "equity").otherwise("crypto")


def market_parts(market: Column) -> Column:
    """Struct (exchange, segment); the segment is null without a dash."""
    dash = F.locate("-", market)
    return F.struct(F.when(dash > 0, F.expr("1")).cast("int").alias("_"), F.substring_index(market, "-", 1).alias("exchange"), F.when(dash > 0, F.substr(market, dash + 1)).alias("segment")).dropFields("_")


def venue_markets(venues: DataFrame) -> DataFrame:
    """(id, market): a venue's segments each as ``id-segment``, or the id alone."""
    segment = F.explode_outer("segments")
    return venues.select("id", segment.alias("s")).select("id", F.when(F.col("s").isNull(), F.col("id")).otherwise(F.concat_ws("-", "id", "s")).alias("market"))


def fuzzy_score(query: str, text: Column) -> Column:
    """1000 for equal, 800 - length for a prefix, 600 - place - length/10 inside, 100 + runs - length/10 for a subsequence, else -1."""
    q = query.strip().lower()
    if not q:
        return F.lit(0.0)
    t = F.lower(text)
    length, place = F.length(t), F.locate(q, t) - 1
    letters = F.filter(F.split(t, ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("q"), F.lit(0.0).alias("score"), F.lit(0).alias("run"), F.lit(-2).alias("prev"), F.lit(0).alias("at"))

    def walk(s: Column, c: Column) -> Column:
        hit = (s["q"] < len(q)) & (c == F.substring(F.lit(q), s["q"] + 1, F.lit(1)))
        run = F.when(s["at"] == s["prev"] + 1, s["run"] + 1).otherwise(1)
        gain = run + F.when(s["at"] == 0, 5).otherwise(0)
        step = lambda yes, no: F.when(hit, yes).otherwise(no)
        return F.struct(step(s["q"] + 1, s["q"]).alias("q"), step(s["score"] + gain, s["score"]).alias("score"), step(run, s["run"]).alias("run"), step(s["at"], s["prev"]).alias("prev"), (s["at"] + 1).alias("at"))

    walked = F.aggregate(letters, start, walk)
    loose = F.when(walked["q"] == len(q), 100 + walked["score"] - length * 0.1).otherwise(-1.0)
    return F.when(t == q, 1000.0).when(place == 0, 800.0 - length).when(place > 0, 600.0 - place - length * 0.1).otherwise(loose)


def fuzzy_rank(entries: DataFrame, query: str, limit: int = 60) -> DataFrame:
    """Best ``limit`` entries by the symbol's score, or the market's less 60; shorter symbols, then smaller ids, come first."""
    score = F.greatest(fuzzy_score(query, F.col("symbol")), fuzzy_score(query, F.col("market")) - 60)
    return entries.withColumn("score", score).where("score >= 0").orderBy(F.desc("score"), F.length("symbol"), "id").limit(limit)


def rank_venues(options: DataFrame, query: str, limit: int = 300) -> DataFrame:
    """Best venues by the market's score, or the label's less 20."""
    score = F.greatest(fuzzy_score(query, F.col("market")), fuzzy_score(query, F.col("label")) - 20)
    return options.withColumn("score", score).where("score >= 0").orderBy(F.desc("score"), F.length("market"), "market").limit(limit)


def filter_directory(entries: DataFrame, query: str = "", market: str = "all", limit: int | None = None) -> DataFrame:
    """Entries whose symbol contains the query, of a class of markets or of one market; the first ``limit`` by id."""
    out = entries
    if market in GROUPS:
        out = out.where(market_group(F.col("market")) == market)
    elif market not in ("", "all"):
        out = out.where(F.col("market") == market)
    if query:
        out = out.where(F.contains(F.lower("symbol"), F.lit(query.lower())))
    return out if limit is None else out.orderBy("id").limit(limit)


def filter_symbols(entries: DataFrame, query: str, labels: dict[str, str] | None = None) -> DataFrame:
    """Entries that hold the query in symbol, market, group or the group's label."""
    q = query.strip().lower()
    labels = labels or {g: g for g in GROUPS}
    group = market_group(F.col("market"))
    label = F.create_map(*(F.lit(x) for g in GROUPS for x in (g, labels[g].lower())))[group]
    holds = F.lit(False)
    for c in (F.lower("symbol"), F.lower("market"), group, label):
        holds |= F.contains(c, F.lit(q))
    return entries.where(holds)


def group_symbols(entries: DataFrame) -> DataFrame:
    """Entries with their group, its place in the order of display, and ``pos`` by id within the group."""
    group = market_group(F.col("market"))
    place = F.array_position(F.array(*map(F.lit, GROUPS)), group).cast("int")
    out = entries.withColumn("grp", group).withColumn("group_rank", place)
    return out.withColumn("pos", F.row_number().over(Window.partitionBy("grp").orderBy("id")))


def resolve_symbols(wanted: DataFrame, mapping: DataFrame) -> DataFrame:
    """(market, symbol, resolved): the venue's own spelling where a mapping knows one, else the symbol as it is."""
    return wanted.join(mapping.select("market", "symbol", "venue_symbol"), ["market", "symbol"], "left").withColumn("resolved", F.coalesce("venue_symbol", "symbol")).drop("venue_symbol")


def with_capability(entries: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Entries joined to the capability of their class of markets; of a class listed twice, one."""
    one = capabilities.where(F.col("grp").isin(*GROUPS)).dropDuplicates(["grp"])  # so at most a row for each of the fixed groups
    return entries.withColumn("grp", market_group(F.col("market"))).join(F.broadcast(one), "grp", "left")


def capability_chips(depth: Column, tape: Column, side: Column) -> Column:
    return F.array_compact(F.array(F.upper(depth), F.concat(F.lit("TAPE "), F.upper(tape)), F.concat(F.lit("SIDE "), F.upper(side))))


def chip_class(chip: Column) -> Column:
    has = lambda x: F.contains(chip, F.lit(x))
    tape = F.when(has("POLL"), "cap cap--tape cap--caution").otherwise("cap cap--tape")
    side = F.when(has("INFERRED") | has("NA"), "cap cap--caution").otherwise("cap")
    depth = F.when(F.startswith(chip, F.lit("SYNTH")), "cap cap--synth").when(chip.isin("N/A", "NA", "NONE", "UNKNOWN", ""), "cap cap--na").when(has("SNAPSHOT"), "cap cap--depth cap--caution").otherwise("cap cap--depth")
    return F.when(F.startswith(chip, F.lit("TAPE")), tape).when(F.startswith(chip, F.lit("SIDE")), side).otherwise(depth)


def quotes(candles: DataFrame, spark_points: int = 64) -> DataFrame:
    """(stream, price, first, change_pct, spark, as_of): last close, change from the first, and the last closes in order."""
    recent = candles.withColumn("_r", F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("t0_ns"))))
    last = F.sort_array(F.collect_list(F.when(F.col("_r") <= spark_points, F.struct("t0_ns", "c"))))  # at most spark_points
    out = recent.groupBy("stream").agg(F.max_by("c", "t0_ns").alias("price"), F.min_by("c", "t0_ns").alias("first"), F.transform(last, lambda x: x["c"]).alias("spark"), F.max("t0_ns").alias("as_of"))
    return out.withColumn("change_pct", F.when(F.col("first") != 0, (F.col("price") - F.col("first")) / F.col("first") * 100))


def movers(quoted: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` largest changes either way; a quote without change is left out."""
    return quoted.where("change_pct IS NOT NULL").orderBy(F.desc(F.abs("change_pct")), "stream").limit(limit)


def merged_movers(first: DataFrame, second: DataFrame, limit: int = 14) -> DataFrame:
    """(place, and the columns of both) of two markets' largest changes, ``limit`` of each, as one list."""
    both = first.orderBy(F.desc(F.abs("change_pct")), "stream").limit(limit).unionByName(second.orderBy(F.desc(F.abs("change_pct")), "stream").limit(limit))
    order = Window.orderBy(F.desc(F.abs(F.coalesce("change_pct", F.lit(0.0)))), "stream")  # of at most twice the limit
    return both.withColumn("place", F.row_number().over(order))


def fresh(quoted: DataFrame, now_ns: int, ttl_ns: int) -> DataFrame:
    """Quotes with ``stale``: older than the time to live."""
    return quoted.withColumn("stale", F.lit(now_ns) - F.col("as_of") > ttl_ns)
