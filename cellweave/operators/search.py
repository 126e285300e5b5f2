"""Search results: filter by facets, merge the answers of several nodes, order mirrors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellweave.constants import CMIP5_FACETS, CMIP6_FACETS, PREFERRED_NODE
from cellweave.session import stage


def search_params(settings: dict, project: str = "CMIP6") -> dict[str, str]:
    """Search facets from user settings; empty ones are left out."""
    names = CMIP6_FACETS if project == "CMIP6" else CMIP5_FACETS
    return {facet: settings[key] for key, facet in names if settings.get(key)}


def facet_search(docs: DataFrame, params: dict[str, str]) -> DataFrame:
    """Documents whose facet lists hold every non-empty value asked for."""
    wanted = {k: v for k, v in params.items() if v}
    tests = [
        F.coalesce(F.array_contains(F.try_element_at("facets", F.lit(k)), v), F.lit(False)) for k, v in wanted.items()
    ]
    return docs.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def facet_flags(
    docs: DataFrame, replica: bool = False, latest: bool = False, data_node: str | None = None
) -> DataFrame:
    """Originals only unless ``replica``; current versions only if ``latest``; one node if given."""
    if not replica:
        docs = docs.where(~F.coalesce("replica", F.lit(False)))
    if latest:
        docs = docs.where(F.col("latest"))
    if data_node:
        docs = docs.where(F.col("data_node") == data_node)
    return docs


def node_rank(node: Column) -> Column:
    return F.when(node == PREFERRED_NODE, 0).otherwise(1)


def node_priority(docs: DataFrame) -> DataFrame:
    """The nodes that answered, the preferred one first."""
    return docs.select("data_node").distinct().orderBy(node_rank(F.col("data_node")), "data_node")


def _records(docs: DataFrame, id_column: str) -> DataFrame:
    known = docs.where(F.coalesce(F.col(id_column), F.lit("")) != "")
    order = F.struct(node_rank(F.col("data_node")), F.col("data_node"), F.col("arrival"))
    rest = [c for c in docs.columns if c != id_column]
    return known.groupBy(id_column).agg(F.count("*").alias("seen"), F.min_by(F.struct(*rest), order).alias("record"))


def merge_nodes(docs: DataFrame, id_column: str) -> DataFrame:
    """One record per id: the first by node and arrival, and how often the id was seen.

    Documents without an id are dropped. ``docs`` has ``arrival``, the order of the answers. Repeats
    combine before the shuffle, since the record is a minimum. The addresses of all repeats are
    :func:`merged_urls`.
    """
    rest = [c for c in docs.columns if c not in (id_column, "url")]
    return _records(docs, id_column).select(id_column, "seen", *[F.col(f"record.{c}").alias(c) for c in rest])


def merged_urls(docs: DataFrame, id_column: str) -> DataFrame:
    """The addresses of :func:`merge_nodes`'s records in long form, ``(id, pos, url)``.

    An id seen once keeps its list as it came, repeats included, ``pos`` being the place in it. A
    repeated id has each of its addresses once, in the order of the address (``pos`` 0). Addresses
    become distinct before the shuffle.
    """
    records = _records(docs, id_column)
    single = records.where("seen = 1").select(id_column, F.posexplode("record.url").alias("pos", "url"))
    repeated = docs.select(id_column, F.explode("url").alias("url")).distinct()
    repeated = repeated.join(records.where("seen > 1").select(id_column), id_column, "left_semi")
    return single.unionByName(repeated.select(id_column, F.lit(0).alias("pos"), "url"))


def http_urls(urls: Column) -> Column:
    """The plain addresses of the ``address|type|service`` entries served over HTTP."""
    served = F.filter(
        urls, lambda u: (F.size(F.split(u, r"\|")) == 3) & (F.split_part(u, F.lit("|"), F.lit(3)) == "HTTPServer")
    )
    return F.transform(served, lambda u: F.split_part(u, F.lit("|"), F.lit(1)))


def http_mirrors(docs: DataFrame) -> DataFrame:
    """One row per document and HTTP mirror, in list order."""
    return docs.select("*", F.posexplode(http_urls(F.col("url"))).alias("pos", "mirror"))


def mirror_preference(url: Column, prefer: str) -> Column:
    """The place in ``prefer`` of the first fragment that the host holds; others come last."""
    fragments = [f.strip() for f in prefer.split(",") if f.strip()]
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    chain = F.lit(len(fragments) + 1)
    for i, fragment in reversed(list(enumerate(fragments))):
        chain = F.when(host.contains(fragment), i).otherwise(chain)
    return chain


def ranked_mirrors(urls: Column, prefer: str) -> Column:
    """Mirrors by preference, ties in order, sorted inside each row's array; no window and no shuffle."""
    keyed = F.transform(
        urls, lambda u, i: F.struct(mirror_preference(u, prefer).alias("rank"), i.alias("pos"), u.alias("url"))
    )
    return F.array_sort(keyed)


def mirror_rank(docs: DataFrame, prefer: str) -> DataFrame:
    """One row per HTTP mirror with its place in the order of preference (from 1)."""
    ranked = ranked_mirrors(http_urls(F.col("url")), prefer)
    return docs.select("*", F.posexplode(ranked).alias("_place", "_m")).select(
        *docs.columns,
        (F.col("_place") + 1).alias("place"),
        F.col("_m.rank").alias("rank"),
        F.col("_m.url").alias("mirror"),
    )


def rank_addresses(addresses: DataFrame, id_column: str, prefer: str) -> DataFrame:
    """The HTTP mirrors of ``(id, pos, url)`` rows with their place (from 1) among all of their id.

    The rows are put in one order and cut into ranges, which may fall inside an id; a place is the
    place in the range plus the rows of the id in earlier ranges. No task holds more than a range,
    whatever one id has. The ranges are written down, so a lost executor can't move them.
    """
    mirrors = addresses.where(F.size(http_urls(F.array("url"))) == 1).select(
        id_column, "pos", F.element_at(http_urls(F.array("url")), 1).alias("mirror")
    )
    order = ["rank", "pos", "mirror"]
    ranged = stage(
        mirrors.withColumn("rank", mirror_preference(F.col("mirror"), prefer))
        .repartitionByRange(id_column, *order)
        .withColumn("_range", F.spark_partition_id()),
        "mirror-ranges",
    )
    earlier = Window.partitionBy(id_column).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(id_column, "_range").agg(F.count("*").alias("_n")).select(
        id_column, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy(id_column, "_range").orderBy(*order))
    placed = ranged.withColumn("_inside", inside).join(before, [id_column, "_range"])
    return placed.select(id_column, (F.col("_before") + F.col("_inside")).cast("int").alias("place"), "rank", "mirror")


def limit_manifest(manifest: DataFrame, n: int | None, by: str) -> DataFrame:
    """The first ``n`` entries by id: each task keeps its own top n, so no full sort."""
    return manifest if not n else manifest.orderBy(by).limit(n)


def vocab_violations(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Facet values that the vocabulary of their facet lacks, with the number of documents.

    Values are counted before the join, so a value that most documents share is one row by then.
    Facets without any vocabulary are not judged.
    """
    used = (
        docs.select(F.explode("facets").alias("facet", "terms"))
        .select("facet", F.explode("terms").alias("term"))
        .groupBy("facet", "term")
        .agg(F.count("*").alias("documents"))
    )
    return used.join(vocab.select("facet").distinct(), "facet", "left_semi").join(
        vocab.select("facet", "term").distinct(), ["facet", "term"], "left_anti"
    )


def granule_search(
    granules: DataFrame,
    bounds: dict | None = None,
    start: str | None = None,
    end: str | None = None,
    flight_direction: str | None = None,
) -> DataFrame:
    """Granules inside a box, a period and with a flight direction; all limits are inclusive."""
    if bounds:
        granules = granules.where(
            F.col("lat").between(float(bounds["south"]), float(bounds["north"]))
            & F.col("lon").between(float(bounds["west"]), float(bounds["east"]))
        )
    if start:
        granules = granules.where(F.col("start") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        granules = granules.where(F.col("start") <= F.lit(end).cast("timestamp_ntz"))
    if flight_direction:
        granules = granules.where(F.col("flight_direction") == flight_direction)
    return granules


def page_spans(pages: DataFrame) -> DataFrame:
    """(node, query, start, found, until) of saved pages: ``node``, ``query`` and the ``page`` text.

    ``found`` is the number of documents that the page says there are, ``until`` where its own documents end.
    """
    parsed = pages.select("node", "query", F.from_json("page", "response struct<numFound:long,start:long,docs:string>")["response"].alias("r"))
    start = F.coalesce("r.start", F.lit(0).cast("long"))
    held = F.coalesce(F.json_array_length("r.docs"), F.lit(0))
    return parsed.select("node", "query", start.alias("start"), F.coalesce("r.numFound", F.lit(0).cast("long")).alias("found"), (start + held).alias("until"))


def search_gaps(pages: DataFrame) -> DataFrame:
    """What pages of a search miss or hold twice: (node, query, kind, first, last), positions from 0, inclusive.

    A lost page, a short page and a missing end are all ``missing``; documents that an earlier page has as
    well are ``repeated``. A search ends at the largest number of documents any of its pages says. Pages are
    put in order per node and query, one row each, so a search of any length is one sorted scan.
    """
    return _gaps(stage(page_spans(pages), "page-spans"))


def _gaps(spans: DataFrame) -> DataFrame:
    """The gaps of spans that are staged, since they are read twice."""
    ends = spans.groupBy("node", "query").agg(F.max("found").alias("found"))
    end = ends.select("node", "query", F.col("found").alias("start"), F.col("found").alias("until"), F.lit(True).alias("is_end"))
    rows = spans.select("node", "query", "start", "until", F.lit(False).alias("is_end")).unionByName(end)
    before = Window.partitionBy("node", "query").orderBy("start", "is_end", "until").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("covered", F.coalesce(F.max("until").over(before), F.lit(0).cast("long")))
    missing = F.when(F.col("start") > F.col("covered"), F.struct(F.lit("missing").alias("kind"), F.col("covered").alias("first"), (F.col("start") - 1).alias("last")))
    shared = F.least("covered", "until")
    repeated = F.when(
        ~F.col("is_end") & (shared > F.col("start")), F.struct(F.lit("repeated").alias("kind"), F.col("start").alias("first"), (shared - 1).alias("last"))
    )
    return seen.select("node", "query", F.explode(F.array_compact(F.array(missing, repeated))).alias("g")).select("node", "query", "g.*")


def search_status(pages: DataFrame) -> DataFrame:
    """(node, query, found, missing, repeated, complete) of each search."""
    spans = stage(page_spans(pages), "page-spans")  # each text is parsed once
    gaps = _gaps(spans).withColumn("n", F.col("last") - F.col("first") + 1)
    sums = gaps.groupBy("node", "query").agg(
        F.sum(F.when(F.col("kind") == "missing", F.col("n")).otherwise(0)).alias("missing"),
        F.sum(F.when(F.col("kind") == "repeated", F.col("n")).otherwise(0)).alias("repeated"),
    )
    every = spans.groupBy("node", "query").agg(F.max("found").alias("found")).join(sums, ["node", "query"], "left")
    zero = F.lit(0).cast("long")
    return every.select(
        "node", "query", "found", F.coalesce("missing", zero).alias("missing"), F.coalesce("repeated", zero).alias("repeated"),
        (F.coalesce("missing", zero) == 0).alias("complete"),
    )
