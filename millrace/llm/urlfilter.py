"""Operator 7: URL filters by temporal lists. DataFrame functions only.

Dated entries (pattern, category, day or time, added or removed) become validity intervals: an entry holds from its
time until the next entry of the same pattern and category. Every capture asks for its host, the host's parent
domains, and these with the leading parts of its path; an as-of join finds, for each of those patterns and each
category, the interval in force when the capture was fetched.

The join is a sorted sweep, in which captures and intervals never multiply: the times at which a pattern is asked for
(once each) and the beginnings of its intervals stand in one order, and the latest beginning is carried forward. A hot
pattern is cut into slices of time. A first sweep over the slices alone, of which there are as many as the time span
has, says which interval is open where each begins; then slices are swept apart from one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, row_key


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to, listed) of ``entries`` (pattern, category, time, added, order).

    Of entries of one pattern and category at the same time the one with the highest ``order`` holds. ``valid_to`` is
    null for the last. Rows with a null pattern, category or time say nothing and are left out; null ``added`` is true.
    """
    known = entries.where("pattern is not null and category is not null and time is not null")
    same = known.groupBy("pattern", "category", "time").agg(F.max_by(F.coalesce("added", F.lit(True)), F.struct("order", F.coalesce("added", F.lit(True)))).alias("listed"))
    following = Window.partitionBy("pattern", "category").orderBy("time")
    return same.select("pattern", "category", F.col("time").alias("valid_from"), F.lead("time").over(following).alias("valid_to"), "listed")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def patterns_of(url: Column, path_depth: int = 2, labels: int = 127) -> Column:
    """Patterns that cover ``url``: its host and parent domains of two to ``labels`` labels, each alone and with its
    first ``path_depth`` path segments (``example.org``, ``example.org/en``). A host of one label stands for itself."""
    parts = F.split(host_of(url), r"\.")
    size = F.size(parts)
    domains = F.when(size >= 2, F.transform(F.sequence(F.greatest(F.lit(1), size - max(labels, 2) + 1), size - 1), lambda k: F.array_join(F.slice(parts, k, size), "."))).otherwise(parts)
    segments = F.slice(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), 1, max(path_depth, 1))
    depths = F.sequence(F.lit(0), F.least(F.size(segments), F.lit(path_depth)))
    paths = F.transform(depths, lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(segments, 1, k), "/"))))
    every = F.flatten(F.transform(domains, lambda d: F.transform(paths, lambda p: F.concat(d, p))))
    return F.when(url.isNotNull() & (host_of(url) != ""), F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def as_of(points: DataFrame, spans: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """Of ``points`` (pattern, category, fetched; each once) those that lie in an interval of ``spans`` that lists them."""
    group = ["pattern", "category", "slice"]
    slice_of = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (slice_seconds * 1_000_000)).alias("slice")
    state = F.struct("valid_to", "listed").alias("state")
    begins = spans.select("pattern", "category", slice_of("valid_from"), F.col("valid_from").alias("at"), F.lit(1).alias("kind"), state)
    asked = points.select("pattern", "category", slice_of("fetched"), F.col("fetched").alias("at"), F.lit(2).alias("kind"), F.lit(None).cast(begins.schema["state"].dataType).alias("state"))
    last = begins.groupBy(*group).agg(F.max_by("state", "at").alias("state"))
    slices = last.unionByName(asked.select(*group, "state").dropDuplicates(group)).groupBy(*group).agg(F.first("state", ignorenulls=True).alias("state"))
    earlier = Window.partitionBy("pattern", "category").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = slices.select(*group, F.lit(None).cast("timestamp").alias("at"), F.lit(0).alias("kind"), F.last("state", ignorenulls=True).over(earlier).alias("state")).where("state is not null")
    upto = Window.partitionBy(*group).orderBy(F.asc_nulls_first("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = begins.unionByName(asked).unionByName(opening).withColumn("held", F.last("state", ignorenulls=True).over(upto))
    in_force = F.col("held.listed") & (F.col("held.valid_to").isNull() | (F.col("at") < F.col("held.valid_to")))
    return swept.where((F.col("kind") == 2) & in_force).select("pattern", "category", F.col("at").alias("fetched"))


def match(captures: DataFrame, entries: DataFrame, path_depth: int | None = None) -> DataFrame:
    """A row for each capture (page_id, url, fetched) and the list entries in force when it was fetched:
    page_id, url, fetched, blocked, n_active, categories (sorted) and first_pattern (the least of those in force).

    Paths are followed for ``path_depth`` segments, as many as the deepest entry has if None, and hosts for as many
    labels as the longest entry has. A null or unreadable url and a null fetch time match nothing. Equal captures give
    equal rows, one each; of repeated entries one counts. Without entries nothing is blocked; without captures there
    are no rows. Other columns of either table are ignored, whatever their names.
    """
    spans = materialise(intervals(entries), "intervals")
    deepest = spans.agg(F.max(F.size(F.split("pattern", "/")) - 1), F.max(F.size(F.split(F.element_at(F.split("pattern", "/"), 1), r"\.")))).first()
    path_depth = (deepest[0] or 0) if path_depth is None else path_depth
    keyed = captures.select("page_id", "url", F.col("fetched").cast("timestamp").alias("fetched")).withColumn("capture", row_key("page_id", "url", "fetched"))
    kinds = spans.groupBy("pattern").agg(F.collect_set("category").alias("listed_as"))  # as many as there are categories
    asked = keyed.where("fetched is not null").select("capture", "fetched", F.explode(patterns_of(F.col("url"), path_depth, deepest[1] or 1)).alias("pattern"))
    listed = materialise(asked.join(kinds, "pattern"), "asked")
    points = listed.select("pattern", "fetched", F.explode("listed_as").alias("category")).distinct()
    active = as_of(points, spans.select("pattern", "category", F.col("valid_from").cast("timestamp").alias("valid_from"), F.col("valid_to").cast("timestamp").alias("valid_to"), "listed"))
    hits = active.groupBy("pattern", "fetched").agg(F.collect_set("category").alias("kinds"))
    pairs = listed.select("capture", "fetched", "pattern").join(hits, ["pattern", "fetched"]).select("capture", F.explode(F.transform("kinds", lambda k: F.struct(F.col("pattern"), k.alias("kind")))).alias("hit"))
    found = pairs.groupBy("capture").agg(F.collect_set("hit").alias("hits"))
    found = found.select("capture", F.size("hits").alias("n"), F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["kind"]))).alias("kinds"), F.array_min(F.transform("hits", lambda h: h["pattern"])).alias("least"))
    joined = keyed.join(found, "capture", "left")
    return joined.select("page_id", "url", "fetched", F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).cast("long").alias("n_active"), F.coalesce(F.array_join("kinds", ","), F.lit("")).alias("categories"), F.col("least").alias("first_pattern"))


def captures_of(pages: DataFrame) -> DataFrame:
    """The test table has no fetch times: one in January 2024 follows from the page's number."""
    second = F.pmod(F.col("page_id") * 7919, F.lit(30 * 86400))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.timestamp_seconds(F.lit(1704067200) + second).alias("fetched"))


def entries_of(events: DataFrame, pages: DataFrame) -> DataFrame:
    """The test tables have no lists either: each event dates an entry on the address of the page with the number
    event_id mod the number of pages. By user_id mod 3 it names the host, the host and first path segment, or the parent domain;
    errors remove the category of the event before, all others add."""
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), F.element_at(F.split(path_of(F.col("url")), "/"), 2).alias("part"))
    kind = F.pmod(F.col("user_id"), F.lit(3))
    dated = events.select("event_id", "ts", kind.alias("kind"), (F.col("event_type") != "error").alias("added"), F.element_at(F.array(*map(F.lit, ("ads", "spam", "adult", "malware"))), (F.pmod(F.col("user_id"), F.lit(4)) + 1).cast("int")).alias("category"), F.pmod("event_id", F.lit(max(1, pages.count()))).alias("page_id"))
    pattern = F.when(F.col("kind") == 0, F.col("host")).when(F.col("kind") == 1, F.concat_ws("/", "host", "part")).otherwise(F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1))
    return dated.join(named, "page_id").select(pattern.alias("pattern"), "category", F.col("ts").alias("time"), "added", F.col("event_id").alias("order"))


SQL = r"""
WITH c AS (
  SELECT page_id, url, epoch_ms((1704067200 + (page_id * 7919) % 2592000) * 1000) AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS seg
  FROM pages),
d AS (SELECT *, string_split(host, '.') AS lab FROM c),
doms AS (SELECT page_id, url, fetched, seg, unnest(list_transform(generate_series(1, greatest(len(lab) - 1, 1)), lambda k: array_to_string(lab[k:], '.'))) AS dom FROM d WHERE host <> ''),
asked AS (SELECT DISTINCT page_id, url, fetched, dom || unnest(list_transform(generate_series(0, least(len(seg), 2)), lambda k: CASE WHEN k = 0 THEN '' ELSE '/' || array_to_string(seg[1:k], '/') END)) AS pattern FROM doms),
named AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/')[2] AS part FROM pages),
e AS (
  SELECT CASE user_id % 3 WHEN 0 THEN host WHEN 1 THEN concat_ws('/', host, part) ELSE regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) END AS pattern,
         (['ads', 'spam', 'adult', 'malware'])[user_id % 4 + 1] AS category, ts AS time, event_type <> 'error' AS added, event_id
  FROM events JOIN named ON events.event_id % (SELECT count(*) FROM pages) = named.page_id),
v AS (SELECT pattern, category, time, arg_max(added, event_id) AS listed FROM e GROUP BY ALL),
i AS (SELECT pattern, category, listed, time AS valid_from, lead(time) OVER (PARTITION BY pattern, category ORDER BY time) AS valid_to FROM v),
h AS (SELECT page_id, url, fetched, count(*) AS n, array_to_string(list_sort(list_distinct(list(category))), ',') AS kinds, min(a.pattern) AS least
      FROM asked a JOIN i ON a.pattern = i.pattern AND listed AND fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to) GROUP BY ALL)
SELECT c.page_id, c.url, c.fetched, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_active, coalesce(kinds, '') AS categories, least AS first_pattern
FROM c LEFT JOIN h ON c.page_id = h.page_id AND c.url = h.url AND c.fetched = h.fetched
"""
