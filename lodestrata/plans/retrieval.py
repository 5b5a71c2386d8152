"""Queries of the retrieval family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.functions.hashing import cache_key, content_hash
from lodestrata.operators import gates, retrieval
from lodestrata.session import fresh_path, table
from lodestrata.sources import term_index

_WORDS = "list_filter(regexp_split_to_array(translate(lower({0}),'äçèéêíñóöüáâúîô','aceeeinoouaauio'),'[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text", "lang", "source")


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(X.words(F.col("text")))).alias("term"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")


def exact_phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.exact_phrases(_texts(spark, d), _phrases(spark, d)).select("query_id", F.col("item_id").alias("doc_id"), "sparse")


_EXACT = "select b.item_id query_id, d.doc_id item_id, 10.0::double sparse from documents d, benchmark b where trim(b.text) <> '' and contains(lower(d.text), lower(b.text))"
_TOKENS = f"with toks as (select doc_id, source, {_WORDS.format('text')} w from documents), tf as (select doc_id, source, len(w) dl, unnest(w) t from toks), f as (select doc_id, source, dl, t, count(*) f from tf group by all), s as (select count(*) n, avg(len(w)) avgdl from toks), df as (select t, count(*) df from f group by t), idf as (select t, case when ln((n-df+0.5)/(df+0.5))>0 then ln((n-df+0.5)/(df+0.5)) else 1e-6 end idf from df, s), q as (select distinct item_id query_id, unnest({_WORDS.format('text')}) t from benchmark), sc as (select query_id, doc_id, any_value(source) source, round(sum(idf*f*2.2/(f+1.2*(0.25+0.75*dl/avgdl))),6) sparse from f join idf using (t) join q using (t), s group by query_id, doc_id)"
_BM25 = f"{_TOKENS}, leg as (select query_id, doc_id item_id, sparse, (row_number() over (partition by query_id order by sparse desc, doc_id))::int rank from sc qualify rank <= 40)"


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(_texts(spark, d), _terms(spark, d))


def source_type_scope_before_rank(spark: SparkSession, d: str) -> DataFrame:
    """Sources outside the scope are dropped before the limit; statistics still cover all texts."""
    return retrieval.bm25(_texts(spark, d), _terms(spark, d), allowed=~F.col("source").isin("src1", "src3", "src7"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")


def dense_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 50, candidates all vectors."""
    return retrieval.cosine_topk(_vectors(spark, d), _queries(spark, d))


_COS = "round(list_dot_product(q.embedding::double[], e.embedding::double[]) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]) * list_dot_product(e.embedding::double[], e.embedding::double[])), 5)"
_DENSE = f"select * from (select q.vec_id query_id, e.vec_id item_id, {_COS} dense, (row_number() over (partition by q.vec_id order by {_COS} desc, e.vec_id))::int rank from embeddings q, embeddings e where q.vec_id % 50 = 0) where rank <= 40 and dense >= 0.25"


def hybrid_union_topk(spark: SparkSession, d: str) -> DataFrame:
    """The union of the three legs, merged by item and capped."""
    legs = [retrieval.exact_phrases(_texts(spark, d), _phrases(spark, d)), retrieval.bm25(_texts(spark, d), _terms(spark, d)), retrieval.cosine_topk(_vectors(spark, d), _queries(spark, d))]
    out = retrieval.capped(retrieval.merge(*legs))
    return out.select("item_id", "sparse", "dense", "combined", F.size("matched").cast("long").alias("n_matched"), "rank")


def candidate_merge(spark: SparkSession, d: str) -> DataFrame:
    legs = [retrieval.exact_phrases(_texts(spark, d), _phrases(spark, d)), retrieval.bm25(_texts(spark, d), _terms(spark, d))]
    return retrieval.merge(*legs).select("item_id", "sparse", F.array_join(F.col("matched").cast("array<string>"), ",").alias("matched"), F.size(F.array_distinct("matched")).cast("long").alias("n_queries"))


def union_cap_record(spark: SparkSession, d: str) -> DataFrame:
    merged = retrieval.merge(retrieval.exact_phrases(_texts(spark, d), _phrases(spark, d)), retrieval.bm25(_texts(spark, d), _terms(spark, d)))
    cap = retrieval.UNION_CAP
    return merged.agg(F.count("*").alias("input_count"), F.least(F.count("*"), F.lit(cap)).cast("long").alias("kept"), (F.count("*") > cap).alias("truncated"))


def coverage_per_query(spark: SparkSession, d: str) -> DataFrame:
    """Distinct candidates of every query of the pack, those without any included."""
    hits = retrieval.bm25(_texts(spark, d), _terms(spark, d)).groupBy("query_id").agg(F.countDistinct("item_id").alias("n"))
    return _phrases(spark, d).select("query_id").join(hits, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))


def source_hash_identity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", content_hash(F.col("text")).alias("sha256"), F.octet_length("text").cast("long").alias("byte_length"), cache_key(F.col("doc_id"), F.col("text")).alias("cache_key"))


def exact_duplicate_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", content_hash(F.col("text")).alias("sha256"))
    return docs.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """An order-independent hash per source: two sums over the hashes of (id, hash of text), which partial
    aggregation adds up without ever gathering a source."""
    own = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), content_hash(F.col("text"))), 256)
    docs = table(spark, d, "documents").select("source", own.alias("h"))
    total = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return docs.groupBy("source").agg(F.concat_ws("-", total(1), total(16)).alias("fingerprint"), F.count("*").alias("n"))


def embedding_cache_missing(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.missing_embeddings(_texts(spark, d), _vectors(spark, d)).select("item_id")


def generation_prune(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the current generation stay; a null generation is another one."""
    docs = table(spark, d, "documents").withColumn("generation", F.when(F.length("text") % 3 == 0, F.lit(None)).otherwise(F.col("lang")))
    return docs.where(F.coalesce("generation", F.lit("")) == "en").groupBy("source").agg(F.count("*").alias("kept"))


def term_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's passages as queries against an index of the documents' terms."""
    index = term_index.TermIndex(spark, fresh_path(spark, "terms"))
    index.build(_texts(spark, d).withColumnRenamed("lang", "scope"))
    return index.search(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 50)


_ANALYSED = "list_filter(string_split(lower(regexp_replace({0}, '[^0-9A-Za-zÀ-￿ ]+', ' ', 'g')), ' '), lambda w: w <> '')"
TERM_INDEX_SQL = f"""with d as (select doc_id, {_ANALYSED.format("text")} w from documents), s as (select count(*) n, avg(len(w)) a from d where len(w) > 0),
t as (select doc_id, len(w) dl, unnest(w) t from d), f as (select doc_id, dl, t, count(*) f from t group by all), df as (select t, count(*) df from f group by 1),
q as (select item_id query_id, unnest({_ANALYSED.format("text")}) t from benchmark), m as (select query_id, t, count(*) m from q where length(t) > 1 group by 1, 2),
sc as (select query_id, doc_id item_id, round(sum(m * ln(1 + (n - df + 0.5) / (df + 0.5)) * f / (f + 1.2 * (0.25 + 0.75 * dl / a))), 6) score from m join f using (t) join df using (t), s group by 1, 2)
select query_id, item_id, score, (row_number() over (partition by query_id order by score desc, item_id))::int "rank" from sc qualify row_number() over (partition by query_id order by score desc, item_id) <= 50"""

QUERIES = {
    "term_index_topk": (term_index_topk, TERM_INDEX_SQL),
    "exact_phrase_hits": (exact_phrase_hits, f"select query_id, item_id doc_id, sparse from ({_EXACT})"),
    "bm25_topk": (bm25_topk, f"{_BM25} select query_id, item_id, sparse, rank from leg"),
    "source_type_scope_before_rank": (source_type_scope_before_rank, f"{_TOKENS} select query_id, doc_id item_id, sparse, (row_number() over (partition by query_id order by sparse desc, doc_id))::int rank from sc where source not in ('src1','src3','src7') qualify rank <= 40"),
    "dense_cosine_topk": (dense_cosine_topk, _DENSE),
    "hybrid_union_topk": (
        hybrid_union_topk,
        f"{_BM25}, u as (select query_id, item_id, sparse, 0.0 dense from ({_EXACT}) union all select query_id, item_id, sparse, 0.0 from leg union all select query_id, item_id, 0.0, dense from ({_DENSE})), m as (select item_id, max(sparse)::double sparse, max(dense)::double dense, count(*) n_matched, round(max(dense)+least(max(sparse),10.0)/10,6)::double combined from u group by item_id) select item_id, sparse, dense, combined, n_matched, (row_number() over (order by combined desc, item_id))::int rank from m qualify rank <= 400",
    ),
    "candidate_merge": (candidate_merge, f"{_BM25}, u as (select query_id, item_id, sparse from ({_EXACT}) union all select query_id, item_id, sparse from leg) select item_id, max(sparse)::double sparse, array_to_string(list_sort(list(query_id)), ',') matched, count(distinct query_id) n_queries from u group by item_id"),
    "union_cap_record": (union_cap_record, f"{_BM25}, u as (select item_id from ({_EXACT}) union select item_id from leg) select count(*) input_count, least(count(*), 400)::bigint kept, count(*) > 400 truncated from u"),
    "coverage_per_query": (coverage_per_query, f"{_BM25} select b.item_id query_id, count(distinct leg.item_id) n from benchmark b left join leg on leg.query_id = b.item_id group by 1"),
    "source_hash_identity": (source_hash_identity, "select doc_id, sha256(text) sha256, strlen(text)::bigint byte_length, doc_id::varchar || ':' || substr(sha256(text),1,16) cache_key from documents"),
    "exact_duplicate_docs": (exact_duplicate_docs, "select sha256(text) sha256, count(*) n, min(doc_id) first_id from documents group by 1 having count(*) > 1"),
    "corpus_fingerprint": (corpus_fingerprint, "with h as (select source, sha256(doc_id::varchar || ':' || sha256(text)) h from documents) select source, sum(('0x' || substr(h,1,15))::bigint)::varchar || '-' || sum(('0x' || substr(h,16,15))::bigint)::varchar fingerprint, count(*) n from h group by source"),
    "embedding_cache_missing": (embedding_cache_missing, "select doc_id item_id from documents where doc_id not in (select vec_id from embeddings)"),
    "generation_prune": (generation_prune, "select source, count(*) kept from documents where length(text) % 3 <> 0 and lang = 'en' group by source"),
}
