"""Open copies of works, whether a document has its body, and spans that a text has outgrown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Parts of the names of hosts that wall their copies, and of repositories; points of hosts, of a file instead of a page, of versions and of licences.
PUBLISHER_HOSTS = [
    "direct.mit.edu", "tandfonline.com", "sciencedirect.com", "link.springer.com", "onlinelibrary.wiley.com", "journals.sagepub.com", "academic.oup.com", "journals.uchicago.edu", "cambridge.org", "jstor.org", "nature.com",
    "science.org", "pubs.acs.org", "ieeexplore.ieee.org", "dl.acm.org", "journals.plos.org", "emerald.com", "degruyter.com",
]
REPOSITORY_HOSTS = [
    "arxiv.org", "ncbi.nlm.nih.gov", "europepmc.org", "ebi.ac.uk", "zenodo.org", "openreview.net", "core.ac.uk", "biorxiv.org", "medrxiv.org", "osf.io", "hal.science", "hal.archives-ouvertes.fr", "ssoar.info", "dspace", "eprints",
    "repository", "repositorio", "hdl.handle.net", "semanticscholar.org", "researchgate", "figshare.com", "preprints.org", "dial.uclouvain.be", "escholarship.org", "digitalcommons", "scholarworks", "diva-portal.org", ".edu", ".ac.uk",
]
HOST_POINTS, FILE_POINTS, VERSION_POINTS, LICENCE_POINTS = {"repository": 200, "unknown": 100, "publisher": 0}, 10, {"published": 6, "accepted": 4, "submitted": 1, "": 2}, {"open": 3, "other": 1, "": 0}
#: Characters of a block that count, and of a paragraph; what a body has at least, by profile; what looks like code and like a reference.
COUNTED, PARAGRAPH, PROFILES = 200, 400, {"scholarly": (5, 10_000), "web": (2, 1_500)}
CODE = r"(?i)(\{[^}]*[\w-]+\s*:\s*[^};]+;)|(\bfunction\s*\()|(\bwindow\.)|(\bdocument\.)|(\bvar\s+\w+\s*=)|(dataLayer)|(@media\b)|(!important)"
REFERENCE = [r"^\s*\[?\d{0,3}\]?\s*[A-Z][A-Za-z'’-]+,\s+[A-Z]\.", r"(?i)\bdoi:\s*10\.|https?://doi\.org/10\.", r"(?i)\bRetrieved from\s+https?:"]


def _holds(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def ranked_copies(locations: DataFrame) -> DataFrame:
    """(work, place, url, kind, host, host_class, score): the copies of each work, the best first, from 1.

    locations: (work, n, pdf_url, landing_page_url, host_type, version, license), n their order. Each address of a location is a copy, its file first; of
    addresses of one host and path, a slash at the end and a query aside, the first is kept. Repositories come before unknown hosts, these before
    publishers; then files before pages, then the version's and the licence's points; then the order they came in. Null and empty addresses are none.
    """
    kinds = F.array(F.struct(F.lit("pdf").alias("kind"), F.col("pdf_url").alias("url")), F.struct(F.lit("landing").alias("kind"), F.col("landing_page_url").alias("url")))
    each = locations.select("work", "n", "host_type", "version", "license", F.posexplode(kinds).alias("k", "c")).select("work", "n", "k", "host_type", "version", "license", "c.kind", "c.url").where("url IS NOT NULL AND url <> ''")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    named = each.withColumns({"host": host, "_key": F.concat(host, path)})
    first = named.withColumn("_r", F.row_number().over(W.partitionBy("work", "_key").orderBy("n", "k"))).where("_r = 1")
    h, t = F.col("host"), F.col("host_type")
    klass = F.when(h == "", "unknown").when(t == "repository", "repository").when(_holds(h, PUBLISHER_HOSTS), "publisher").when(_holds(h, REPOSITORY_HOSTS), "repository").when(t.isin("publisher", "journal"), "publisher").otherwise("unknown")
    v, li = F.lower(F.coalesce("version", F.lit(""))), F.lower(F.coalesce("license", F.lit("")))
    version = F.when(v.contains("published"), VERSION_POINTS["published"]).when(v.contains("accepted"), VERSION_POINTS["accepted"]).when(v.contains("submitted"), VERSION_POINTS["submitted"]).otherwise(VERSION_POINTS[""])
    licence = F.when(li == "", LICENCE_POINTS[""]).when(li.startswith("cc") | li.contains("public-domain") | (li == "pd"), LICENCE_POINTS["open"]).otherwise(LICENCE_POINTS["other"])
    points = F.create_map(*[F.lit(x) for kv in HOST_POINTS.items() for x in kv])
    scored = first.withColumn("host_class", klass).withColumn("score", points[F.col("host_class")] + F.when(F.col("kind") == "pdf", FILE_POINTS).otherwise(0) + version + licence)
    place = F.row_number().over(W.partitionBy("work").orderBy(F.desc("score"), "n", "k"))
    return scored.select("work", place.alias("place"), "url", "kind", "host", "host_class", "score")


def body_verdict(blocks: DataFrame, doc: str, text: str, profile: str = "scholarly") -> DataFrame:
    """(doc, prose_blocks, prose_chars, verdict): present, or absent where a document has fewer paragraphs and fewer characters of prose than its profile asks.

    Blocks of 200 characters or more count, white space as one space, if they look neither like code nor like a reference; those of 400 are paragraphs.
    A document whose blocks are all null or short has none of either.
    """
    plain = F.btrim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    rows = blocks.select(F.col(doc), plain.alias("_t"))
    size = F.length("_t")
    counts = (size >= COUNTED) & ~F.col("_t").rlike(CODE) & ~reduce(lambda a, b: a | b, [F.col("_t").rlike(p) for p in REFERENCE])
    least, chars = PROFILES[profile]
    g = rows.groupBy(doc).agg(F.count_if(counts & (size >= PARAGRAPH)).alias("prose_blocks"), F.coalesce(F.sum(F.when(counts, size)), F.lit(0)).alias("prose_chars"))
    return g.withColumn("verdict", F.when((F.col("prose_blocks") < least) & (F.col("prose_chars") < chars), "absent").otherwise("present"))


def pruned_spans(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """items without the entries of nodes whose span begins at or after the node's end.

    items: (item, book, node_ids: array, starts: map of node to where its span begins); nodes: (book, node, text, content). A node that is unknown, has no
    text, or whose content has a formula keeps its entry, as does one without a start. An item of one node is left as it is, and so is one that would lose all.
    """
    lengths = nodes.where("text IS NOT NULL AND NOT coalesce(contains(content, '<latex'), false)").select("book", F.col("node").alias("_node"), F.length("text").alias("_length"))
    asked = items.where(F.size("node_ids") >= 2).select("item", "book", F.explode(F.array_distinct("node_ids")).alias("_node"), F.col("starts"))
    late = asked.join(lengths, ["book", "_node"]).where(F.try_element_at("starts", F.col("_node")) >= F.col("_length"))
    stale = late.groupBy("item").agg(F.collect_set("_node").alias("_stale"))
    both = items.join(stale, "item", "left")
    kept = F.array_except("node_ids", "_stale")
    cut = F.col("_stale").isNotNull() & (F.size(kept) >= 1)
    return both.select("item", "book", F.when(cut, F.filter("node_ids", lambda n: ~F.array_contains("_stale", n))).otherwise(F.col("node_ids")).alias("node_ids"), F.when(cut, F.map_filter("starts", lambda k, v: ~F.array_contains("_stale", k))).otherwise(F.col("starts")).alias("starts"))
