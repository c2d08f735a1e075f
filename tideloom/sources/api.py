"""Rows of landed answers of web interfaces: (body) holds one JSON answer a row; what an answer lacks is null or gives no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parsed(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json("body", schema).alias("j")).where("j IS NOT NULL")


def revisions(df: DataFrame) -> DataFrame:
    """(title, page_id, rev_id, ts, user, comment, text) of page and revision answers; the next request's offset is in `next_offset`."""
    rev = "array<struct<revid:bigint,timestamp:string,user:string,comment:string,content:string,slots:struct<main:struct<content:string>>>>"
    j = _parsed(df, f"query struct<pages:array<struct<pageid:bigint,title:string,revisions:{rev}>>>, `continue` struct<rvcontinue:string>")
    r = j.select(F.col("j.continue.rvcontinue").alias("next_offset"), F.explode("j.query.pages").alias("p")).select("next_offset", "p.title", F.col("p.pageid").alias("page_id"), F.explode("p.revisions").alias("r"))
    return r.select("title", "page_id", F.col("r.revid").alias("rev_id"), F.col("r.timestamp").alias("ts"), "r.user", "r.comment", F.coalesce("r.slots.main.content", "r.content").alias("text"), "next_offset")


def category_members(df: DataFrame) -> DataFrame:
    """(page_id, ns, title, next_offset)."""
    j = _parsed(df, "query struct<categorymembers:array<struct<pageid:bigint,ns:int,title:string>>>, `continue` struct<cmcontinue:string>")
    return j.select(F.explode("j.query.categorymembers").alias("m"), F.col("j.continue.cmcontinue").alias("next_offset")).select(F.col("m.pageid").alias("page_id"), "m.ns", "m.title", "next_offset")


def file_usage(df: DataFrame, site: str | None = None) -> DataFrame:
    """(file, wiki, title) of uses of files, of one site if named; a file nobody uses has no row here, its name is in `files`."""
    j = _parsed(df, "query struct<pages:array<struct<title:string,globalusage:array<struct<wiki:string,title:string>>>>>")
    u = j.select(F.explode("j.query.pages").alias("p")).select(F.col("p.title").alias("file"), F.explode("p.globalusage").alias("u")).select("file", "u.wiki", "u.title")
    return u.where(F.col("wiki") == site) if site else u


def files(df: DataFrame) -> DataFrame:
    return _parsed(df, "query struct<pages:array<struct<title:string>>>").select(F.explode("j.query.pages.title").alias("file")).distinct()


def namespaces(df: DataFrame) -> DataFrame:
    """(prefix, ns): every name and alias of the namespaces from 0 on, in lower case with blanks as underscores."""
    j = _parsed(df, "query struct<namespaces:map<string,struct<id:int,name:string,canonical:string>>,namespacealiases:array<struct<id:int,alias:string>>>")
    n = j.select(F.explode(F.map_values("j.query.namespaces")).alias("n")).select(F.col("n.id").alias("ns"), F.explode(F.array_compact(F.array("n.name", "n.canonical"))).alias("name"))
    a = j.select(F.explode("j.query.namespacealiases").alias("n")).select(F.col("n.id").alias("ns"), F.col("n.alias").alias("name"))
    return n.unionByName(a).where("ns >= 0 AND name <> ''").select(F.lower(F.replace("name", F.lit(" "), F.lit("_"))).alias("prefix"), "ns").distinct()


def link_target(title: Column, prefixes: dict[str, int]) -> Column:
    """Struct (ns, title): the number of a known prefix and the rest, else 0 and the whole title."""
    table = F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair]) if prefixes else F.expr("cast(map() as map<string,int>)")
    t = F.replace(F.trim(title), F.lit(" "), F.lit("_"))
    ns = F.when(F.instr(t, ":") > 1, F.try_element_at(table, F.lower(F.rtrim(F.replace(F.split_part(t, F.lit(":"), F.lit(1)), F.lit("_"), F.lit(" "))))))
    rest = F.regexp_replace(F.regexp_extract(t, r"^[^:]*:(.*)$", 1), r"^_+", "")
    return F.struct(F.coalesce(ns, F.lit(0)).alias("ns"), F.when(ns.isNotNull(), rest).otherwise(t).alias("title"))


def entities(df: DataFrame) -> DataFrame:
    """(qid, classes, sitelinks) of items: the values of their class claims and titles by site."""
    value = "struct<mainsnak:struct<datavalue:struct<value:struct<id:string>>>>"
    j = _parsed(df, f"entities map<string,struct<claims:struct<P31:array<{value}>>,sitelinks:map<string,struct<title:string>>>>")
    e = j.select(F.explode("j.entities").alias("qid", "e"))
    return e.select("qid", F.coalesce(F.array_compact(F.transform("e.claims.P31", lambda x: x.mainsnak.datavalue.value.id)), F.array().cast("array<string>")).alias("classes"), F.transform_values("e.sitelinks", lambda k, v: v.title).alias("sitelinks"))


def language_links(df: DataFrame) -> DataFrame:
    """(title, lang, target)."""
    j = _parsed(df, "query struct<pages:array<struct<title:string,langlinks:array<struct<lang:string,title:string>>>>>")
    return j.select(F.explode("j.query.pages").alias("p")).select("p.title", F.explode("p.langlinks").alias("l")).select("title", "l.lang", F.col("l.title").alias("target"))


def search_results(df: DataFrame) -> DataFrame:
    """(title, year, doi, url, authors, abstract, next_cursor) of a literature search whose abstracts are inverted indexes."""
    w = "struct<title:string,publication_year:int,doi:string,open_access:struct<oa_url:string>,authorships:array<struct<author:struct<display_name:string>>>,abstract_inverted_index:map<string,array<int>>>"
    j = _parsed(df, f"results array<{w}>, meta struct<next_cursor:string>")
    r = j.select(F.explode("j.results").alias("w"), F.col("j.meta.next_cursor").alias("next_cursor"))
    places = F.flatten(F.transform(F.map_entries("w.abstract_inverted_index"), lambda e: F.transform(e.value, lambda i: F.struct(i.alias("i"), e.key.alias("w")))))
    abstract = F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " ")
    return r.select("w.title", F.col("w.publication_year").alias("year"), "w.doi", F.col("w.open_access.oa_url").alias("url"), F.transform("w.authorships", lambda a: a.author.display_name).alias("authors"), F.coalesce(abstract, F.lit("")).alias("abstract"), "next_cursor")


def works(df: DataFrame) -> DataFrame:
    """(doi, title, authors, year, journal, volume, issue, pages, publisher, type) of registered works."""
    j = _parsed(df, "message struct<DOI:string,title:array<string>,author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>,`container-title`:array<string>,volume:string,issue:string,page:string,publisher:string,type:string>")
    m = j.select("j.message.*")
    first = lambda c: F.get(F.col(c), F.lit(0))
    year = F.get(F.get(F.col("issued")["date-parts"], F.lit(0)), F.lit(0))
    return m.select(F.lower("DOI").alias("doi"), first("title").alias("title"), F.col("author").alias("authors"), year.alias("year"), first("`container-title`").alias("journal"), "volume", "issue", F.col("page").alias("pages"), "publisher", "type")


def blocks(df: DataFrame) -> DataFrame:
    """(target, by_user, started, until, reason, n_addresses) of block lists; an endless block has no end."""
    from tideloom.operators.sequences import cidr_size

    j = _parsed(df, "query struct<blocks:array<struct<user:string,`by`:string,timestamp:string,expiry:string,reason:string>>>")
    b = j.select(F.explode("j.query.blocks").alias("b")).select(F.col("b.user").alias("target"), F.col("b.by").alias("by_user"), F.col("b.timestamp").try_cast("timestamp").alias("started"), F.when(F.col("b.expiry") != "infinity", F.col("b.expiry")).try_cast("timestamp").alias("until"), "b.reason")
    return b.withColumn("n_addresses", F.when(F.col("target").rlike(r"^\d{1,3}(\.\d{1,3}){3}(/\d{1,2})?$"), cidr_size(F.col("target"))))
