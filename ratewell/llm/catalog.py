"""Queries of this package, with the parameters used in production, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratewell.llm import centroids, exact_dedup, near_dedup, packing, pieces, pii, quality_rules, site_quality, substring_dedup, suffix_dedup, toxicity, warc, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(_documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_documents(spark, sf_dir), shingle=4)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.coding_digest(_documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(_documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(_documents(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.posterior_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_exact_dedup, op3_minhash_near_dedup, op4_toxicity, op5_sentencepiece, op6_quality_rules, op7_pii, op8_packing, op9_substring_dedup, op10_quality_classifier, op11_warc, op12_centroid_clustering, op13_embedding_whitening)}

#: The words of a text.
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Centroids of round {r}: (cluster, c); a round's near table has every vector's squared distance to each of them.
_NEAR = """
near{r} as (select i, vec_id, x, cluster, list_sum(list_transform(range(1, 65), lambda j: (x[j] - c[j]) * (x[j] - c[j])))::bigint distance from v cross join c{r} qualify row_number() over (partition by i order by distance, cluster) = 1),"""
_ROUND = """
m{s} as (select cluster, list(q order by j) c from (select cluster, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) q from (select cluster, unnest(range(1, 65)) j, unnest(x) x from near{r}) group by cluster, j) group by cluster),
c{s} as (select cluster, coalesce(m{s}.c, c{r}.c) c from c{r} left join m{s} using (cluster)),"""
_CLUSTERS = "".join(_NEAR.format(r=r) + (_ROUND.format(r=r, s=r + 1) if r < 3 else "") for r in range(4))

ORACLE_SQL = {
    # In blocks of 250 starts, as a substring of a long text costs as much as what stands before it.
    "op1_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
block as (select doc_id, 250 * b first, substr(h, 500 * b + 1, 998) p from (select doc_id, h, unnest(range(0, (len(h) // 2 - 250) // 250 + 1)) b from d where len(h) >= 500)),
short as (select doc_id, first + j i, hash(substr(p, 2 * j + 1, 500)) s from (select doc_id, first, p, unnest(range(0, least(250, len(p) // 2 - 249))) j from block)),
again as (select doc_id, i from short semi join (select s from short group by s having count(*) > 1) t using (s)),
long as (select doc_id, i, hash(substr(h, 2 * i + 1, 800)) s from again join d using (doc_id) where 2 * i + 800 <= len(h)),
found as (select doc_id, 250 level, i from again union all select doc_id, 400, i from long semi join (select s from long group by s having count(*) > 1) t using (s)),
hit as (select doc_id, level, i, i - row_number() over (partition by doc_id, level order by i) run from found),
stretch as (select doc_id, level, min(i) a, max(i) + level b from hit group by doc_id, level, run),
mark as (select *, case when a <= max(b) over (partition by doc_id, level order by a rows between unbounded preceding and 1 preceding) then 0 else 1 end new from stretch),
span as (select doc_id, level, min(a) a, max(b) b from (select *, sum(new) over (partition by doc_id, level order by a) g from mark) group by doc_id, level, g),
gap as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) last from span where level = 400),
kept as (select doc_id, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) k from gap join d using (doc_id) group by doc_id),
n as (select doc_id, sum(b - a) filter (level = 400) removed, count(*) filter (level = 400) spans, sum(b - a) filter (level = 250) short, count(*) filter (level = 250) short_spans from span group by doc_id)
select d.doc_id, len(h) // 2 n_bytes, coalesce(removed, 0)::bigint n_removed, coalesce(spans, 0) n_spans, sha256(unhex(coalesce(k, h))) kept_sha256, coalesce(short, 0)::bigint n_short, coalesce(short_spans, 0) n_short_spans from d left join kept using (doc_id) left join n using (doc_id)""",
    "op2_exact_dedup": """
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents)
select doc_id, max(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
       doc_id = max(doc_id) over (partition by t) kept, sha256(t) text_sha256
from n""",
    "op3_minhash_near_dedup": f"""
with recursive d as (select doc_id, {_WORDS.format(_FOLDED)} w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) end) s from d),
x as (select doc_id, len(s) n, unnest(s) g from s),
k as (select g, list(doc_id) ids, list(n) ns from x group by g having count(*) > 1),
pair as (select a.doc_id a, b.doc_id b, count(*) c, any_value(a.n) na, any_value(b.n) nb from x a join x b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by a.doc_id, b.doc_id having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
link as (select a, b from pair union all select b, a from pair),
reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
low as (select a doc_id, least(a, min(b)) component_id from reach group by a)
select s.doc_id, len(s) n_shingles, coalesce(component_id, s.doc_id) component_id, s.doc_id = coalesce(component_id, s.doc_id) kept from s left join low using (doc_id)""",
    "op9_substring_dedup": f"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} w from documents),
win as (select doc_id, i, array_to_string(w[i : i + 12], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 11)) i from d where len(w) >= 13)),
low as (select s, min(doc_id) first from win group by s),
hit as (select distinct doc_id, i + j p from win join low using (s), (select unnest(range(0, 13)) j) where first < doc_id),
gone as (select doc_id, list(p) ps, count(*) n from hit group by doc_id),
word as (select d.doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p from d),
kept as (select word.doc_id, string_agg(x, ' ' order by p) t from word anti join hit on word.doc_id = hit.doc_id and word.p = hit.p group by word.doc_id)
select d.doc_id, len(w) n_words, coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join gone using (doc_id) left join kept using (doc_id)""",
    "op11_warc": """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
d as (select page_id, octet_length(b) payload_bytes, sha1(b) h, max(page_id) over (partition by b) top from p)
select page_id, payload_bytes, case when page_id < top then 'revisit' else 'response' end record_type, case when page_id < top then top end refers_to,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::int, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') payload_digest
from d""",
    "op12_centroid_clustering": f"""
with v as (select row_number() over () i, vec_id, list_transform(embedding, lambda e: floor(64 * e::double)::bigint) x from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda e: isfinite(e))) = 64),
c0 as (select (row_number() over (order by sha256('1:' || vec_id), x) - 1)::int cluster, x c from v order by sha256('1:' || vec_id), x limit 16),{_CLUSTERS}
s as (select cluster, sum(distance)::bigint cluster_inertia from near3 group by cluster)
select vec_id, cluster, distance, cluster_inertia, (select sum(distance)::bigint from near3) inertia, sha256(array_to_string(c, ',')) centroid_sha256 from near3 join s using (cluster) join c3 using (cluster)""",
}
