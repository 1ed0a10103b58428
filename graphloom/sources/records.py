"""Readers of bibliographic records, each giving the columns of SCHEMA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

REFERENCE = "struct<source_paper_id:string,canonical_id:string,title:string,year:int,doi:string,arxiv_id:string,s2_paper_id:string>"
SCHEMA = (
    "source string, source_id string, title string, abstract string, authors array<string>, year int, publication_date string, venue string, doi string, arxiv_id string, s2_paper_id string, url string, "
    f"citation_count int, reference_count int, references array<{REFERENCE}>, seed_queries array<string>"
)
ATOM = "id string, title string, summary string, published string, author array<struct<name:string>>, link array<struct<_href:string,_title:string,_rel:string>>, `arxiv:primary_category` struct<_term:string>, `arxiv:doi` string"


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def _shaped(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    """The columns of SCHEMA, null where not given."""
    kinds = dict(part.strip().split(" ", 1) for part in SCHEMA.replace(REFERENCE, "REF").split(", "))
    given = {"source": F.lit(source), "seed_queries": F.array(), "references": F.array()} | columns
    return rows.select(*[given.get(c, F.lit(None)).cast(t.replace("REF", REFERENCE)).alias(c) for c, t in kinds.items()])


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds: the id without its version, the date's first ten characters, the journal or else the primary category as venue. Empty feeds give no rows."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path)
    arxiv = F.nullif(F.regexp_replace(F.regexp_extract("id", r"/(?:abs|pdf)/([^?#/]+)", 1), r"v\d+$", ""), F.lit(""))
    journal = F.get(F.filter("link", lambda x: x["_title"] == "journal_ref"), 0)["_href"]
    names = F.filter(F.transform("author", lambda a: squeeze(a["name"])), lambda n: F.coalesce(n != "", F.lit(False)))
    return _shaped(
        rows, "arxiv", source_id=F.coalesce(arxiv, F.col("id")), title=F.coalesce(squeeze(F.col("title")), F.lit("")), abstract=squeeze(F.col("summary")), authors=names,
        year=F.expr("try_cast(substr(published, 1, 4) AS int)"), publication_date=F.substring("published", 1, 10), venue=F.coalesce(journal, F.col("`arxiv:primary_category`._term")),
        doi=F.nullif(F.trim("`arxiv:doi`"), F.lit("")), arxiv_id=arxiv, url=F.col("id"),
    )


def abstract_of(index: Column) -> Column:
    """Words of a map from word to positions, in order of position; of words that claim one position the map's last wins."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), (-i).alias("i"), e["key"].alias("w")))))
    ordered = F.array_sort(pairs)
    first = F.filter(ordered, lambda x, k: (k == 0) | (x["p"] != F.get(ordered, k - 1)["p"]))
    return F.array_join(F.transform(first, lambda x: x["w"]), " ")


OPENALEX = "id:string, doi:string, title:string, display_name:string, publication_year:int, publication_date:string, cited_by_count:int, referenced_works:array<string>, authorships:array<struct<author:struct<display_name:string>>>, abstract_inverted_index:map<string,array<int>>, primary_location:struct<source:struct<display_name:string>>, ids:struct<doi:string>"


def _parse(fields: str) -> StructType:
    return DataType.fromDDL(f"struct<{fields}>")


def _works(rows: DataFrame) -> DataFrame:
    bare = lambda x: F.replace(x, F.lit("https://openalex.org/"), F.lit(""))
    doi = F.coalesce("doi", "ids.doi")
    arxiv = F.nullif(F.regexp_extract(doi, r"(?i)10\.48550/arxiv\.?(.+)$", 1), F.lit(""))
    cited = F.coalesce("referenced_works", F.array().cast("array<string>"))
    refs = F.transform(cited, lambda r: F.struct(bare(r).alias("source_paper_id"), F.concat(F.lit("openalex:"), bare(r)).alias("canonical_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("title", "string"), ("year", "int"), ("doi", "string"), ("arxiv_id", "string"), ("s2_paper_id", "string"))]))
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: F.coalesce(n != "", F.lit(False)))
    return _shaped(
        rows, "openalex", source_id=F.coalesce(bare(F.col("id")), F.lit("")), title=F.coalesce(F.nullif("display_name", F.lit("")), "title", F.lit("")), abstract=abstract_of(F.col("abstract_inverted_index")), authors=names,
        year=F.col("publication_year"), publication_date=F.col("publication_date"), venue=F.col("primary_location.source.display_name"), doi=doi, arxiv_id=arxiv, url=F.col("id"),
        citation_count=F.col("cited_by_count"), reference_count=F.size(cited), references=refs,
    )


def read_openalex(spark: SparkSession, path: str) -> DataFrame:
    """Works of search answers (an object with ``results``)."""
    return _works(spark.read.schema(f"results array<struct<{OPENALEX}>>").json(path, multiLine=True).select(F.explode("results").alias("w")).select("w.*"))


def read_openalex_work(spark: SparkSession, path: str) -> DataFrame:
    """Works that were fetched one by one (an object is a work)."""
    return _works(spark.read.schema(_parse(OPENALEX)).json(path, multiLine=True))


PAPER = "paperId:string,title:string,abstract:string,year:int,publicationDate:string,venue:string,url:string,citationCount:int,referenceCount:int,externalIds:struct<DOI:string,ArXiv:string>,authors:array<string>"


def _papers(rows: DataFrame) -> DataFrame:
    # Authors come as objects with a name or as plain strings.
    names = F.filter(F.transform("authors", lambda a: F.when(F.startswith(F.ltrim(a), F.lit("{")), F.get_json_object(a, "$.name")).otherwise(a)), lambda n: F.coalesce(n != "", F.lit(False)))
    return _shaped(
        rows, "semantic_scholar", source_id=F.coalesce("paperId", F.lit("")), title=F.coalesce("title", F.lit("")), abstract=F.col("abstract"), authors=names, year=F.col("year"), publication_date=F.col("publicationDate"), venue=F.col("venue"),
        doi=F.col("externalIds.DOI"), arxiv_id=F.col("externalIds.ArXiv"), s2_paper_id=F.col("paperId"), url=F.col("url"), citation_count=F.col("citationCount"), reference_count=F.col("referenceCount"),
    )


def read_semantic_scholar(spark: SparkSession, path: str) -> DataFrame:
    """Papers of search answers (an object with ``data``)."""
    return _papers(spark.read.schema(f"data array<struct<{PAPER}>>").json(path, multiLine=True).select(F.explode("data").alias("w")).select("w.*"))


def read_semantic_scholar_references(spark: SparkSession, path: str) -> DataFrame:
    """Papers that a paper cites, from answers whose ``data`` hold ``citedPaper``; those without an id are left out."""
    rows = spark.read.schema(f"data array<struct<citedPaper:struct<{PAPER}>>>").json(path, multiLine=True).select(F.explode("data").alias("w")).select("w.citedPaper.*")
    return _papers(rows.where("coalesce(paperId, '') <> ''"))


def citation_contexts(rows: DataFrame) -> DataFrame:
    """(citing, cited, context): one row per context, one with a null context where there is none."""
    return rows.select("citing", "cited", F.explode_outer("contexts").alias("context"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files as they are: the lineage of what is read from them."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def with_lineage(records: DataFrame, digests: DataFrame, path_col: str = "raw_path") -> DataFrame:
    """records with ``raw_sha256``, the digest of the file that each came from."""
    return records.join(digests.select(F.col("path").alias(path_col), F.col("sha256").alias("raw_sha256")), path_col, "left")


def reference_targets(records: DataFrame, papers: int = 10, each: int = 20) -> DataFrame:
    """(source_id, target): references of the first ``papers`` records (by rec_ord), at most ``each`` of them, to works that are not among the records.

    The list of a one-hop expansion: what is to be fetched next. The two bounds are the expansion's own limits.
    """
    some = records.orderBy("rec_ord").limit(papers)
    refs = some.select("source_id", "rec_ord", F.posexplode(F.slice("references", 1, each)).alias("pos", "r")).select("source_id", "rec_ord", "pos", F.col("r.source_paper_id").alias("target")).where("target IS NOT NULL")
    return refs.join(records.select(F.col("source_id").alias("target")).distinct(), "target", "left_anti").select("source_id", "target").distinct()


def expanded(records: DataFrame, fetched: DataFrame) -> DataFrame:
    """records and the fetched ones behind them, each fetched work once and only where it is not there yet."""
    new = fetched.dropDuplicates(["source", "source_id"]).join(records.select("source", "source_id"), ["source", "source_id"], "left_anti")
    return records.unionByName(new, allowMissingColumns=True)
