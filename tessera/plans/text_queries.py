"""Queries of the text, file, chunk and identity operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import text as T
from tessera.functions import values as V
from tessera.operators import chunking, graph, incremental
from tessera.plans.derive import CHUNKS, FILES, NODES, Tables, big, query, r6

BRACES = lambda s: s.replace("{", "{{").replace("}", "}}")
TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')"


@query(f"SELECT path, start_line, end_line, sha256(content) AS hash FROM ({CHUNKS}) c")
def chunk_linear(t: Tables) -> DataFrame:
    return t.chunks.select("path", *big("start_line", "end_line"), "hash")


@query(f"SELECT sha256(concat_ws(chr(0), path, CAST(start_line AS STRING), CAST(end_line AS STRING), sha256(content))) AS vector_id, trim(content) <> '' AS embeddable FROM ({CHUNKS}) c")
def chunk_identity(t: Tables) -> DataFrame:
    return t.chunks.select("vector_id", "embeddable")


@query(f"SELECT sha256(string_agg(v, chr(0) ORDER BY v)) AS digest FROM (SELECT DISTINCT sha256(concat_ws(chr(0), path, CAST(start_line AS STRING), CAST(end_line AS STRING), sha256(content))) AS v FROM ({CHUNKS}) c)")
def vector_ids_digest(t: Tables) -> DataFrame:
    return graph.pairs_digest(t.chunks)


@query(f"SELECT path, CASE WHEN path LIKE '%.py' OR path LIKE '%.js' THEN 'code' WHEN path LIKE '%.md' OR path LIKE '%.txt' THEN 'document' END AS kind, CASE WHEN path LIKE '%.py' OR path LIKE '%.js' THEN 'code' WHEN path LIKE '%.png' THEN 'image' ELSE 'doc' END AS category, source AS folder FROM ({FILES}) f")
def classify_files(t: Tables) -> DataFrame:
    p = F.col("path")
    return t.files.select("path", T.file_kind(p).alias("kind"), T.category(p).alias("category"), T.top_folder(p).alias("folder"))


#: Names of files as they come, in capitals, and with endings of either case.
NAMED = """SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN upper(url) WHEN 2 THEN 'a/SERVER.PEM' WHEN 3 THEN 'a/ID.Key' WHEN 4 THEN '.ENV' WHEN 5 THEN 'x/id_rsa.pub' WHEN 6 THEN 'x/ID_RSA' ELSE 'x/my_Token_' || CAST(page_id AS STRING) || '.txt' END AS path FROM {pages}"""


@query(f"SELECT page_id, path, page_id % 8 IN (2, 3, 4, 5, 7) OR contains(lower(split_part(path, '/', -1)), 'token') OR contains(lower(split_part(path, '/', -1)), 'secret') AS sensitive FROM ({NAMED}) n")
def sensitive_files(t: Tables) -> DataFrame:
    return t.sql(NAMED).select("page_id", "path", T.sensitive(F.col("path")).alias("sensitive"))


@query(f"SELECT path, contains('/' || path, '/tests/') AS test FROM ({FILES}) f")
def test_docs_paths(t: Tables) -> DataFrame:
    return t.files.select("path", T.test_or_docs(F.col("path")).alias("test"))


@query(f"SELECT p AS path, regexp_matches(p, '(^|/)(venv|env|node_modules|dist|build|target|out)/') OR regexp_matches(p, '(^|/)[^/]*(_venv|_env|[.]egg-info)/') AS noise FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'build/' WHEN 1 THEN 'my_env/' WHEN 2 THEN 'src/' ELSE '' END || path AS p FROM ({FILES}) f)")
def noise_paths(t: Tables) -> DataFrame:
    d = F.col("doc_id") % 4
    p = F.concat(F.when(d == 0, "build/").when(d == 1, "my_env/").when(d == 2, "src/").otherwise(""), F.col("path"))
    return t.files.select(p.alias("path"), T.noisy(p).alias("noise"))


@query(f"SELECT path, regexp_matches(path, '^src1/.*') OR regexp_matches(path, '[.]md$') OR regexp_matches('/' || path, '/tests/') AS ignored FROM ({FILES}) f")
def ignored_paths(t: Tables) -> DataFrame:
    return t.files.select("path", T.ignored(F.col("path"), ["src1/*", "*.md", "tests"]).alias("ignored"))


_PAPER = " + ".join(f"CAST(regexp_matches(h, '{p}') AS BIGINT)" for p in C.PAPER_SIGNALS)


#: Texts with signs of papers in front of some, so that each sign is met and missed.
SIGNED = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'ArXiv 1706.03762 ' WHEN 1 THEN '[' || chr(10) || '12' || chr(10) || '] Eq. 4 et al ' WHEN 2 THEN 'DOI : x; We Propose [3] ' WHEN 3 THEN 'Abstract, journal and proceedings ' ELSE '' END || text AS text FROM {documents}"


@query("SELECT doc_id, " + BRACES(_PAPER) + f" AS signals FROM (SELECT doc_id, left(text, 3000) AS h FROM ({SIGNED}) s) d")
def paper_signals(t: Tables) -> DataFrame:
    return t.sql(SIGNED).select("doc_id", T.paper_signals(F.col("text")).cast("long").alias("signals"))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS BIGINT) AS words FROM {documents}")
def word_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"))


@query("SELECT lower(trim(regexp_replace('part_' || p_brand || '_' || p_name, '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS id, p_partkey FROM {part}")
def make_id(t: Tables) -> DataFrame:
    return t.part.select(T.make_id(F.lit("_part."), F.col("p_brand"), F.col("p_name")).alias("id"), "p_partkey")


@query("SELECT trim(regexp_replace(lower(c_name || ' (' || c_mktsegment || ')'), '[^a-z0-9 ]', '', 'g')) AS k, count(*) AS n FROM {customer} GROUP BY 1")
def norm_label(t: Tables) -> DataFrame:
    return t.customer.groupBy(T.label_key(F.concat(F.col("c_name"), F.lit(" ("), F.col("c_mktsegment"), F.lit(")"))).alias("k")).agg(F.count("*").alias("n"))


@query(f"SELECT w AS term, count(*) AS n FROM (SELECT unnest({BRACES(TOK)}) AS w FROM {{documents}}) x GROUP BY 1")
def tokenize_counts(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, left(regexp_replace(coalesce(text, ''), '[\x00-\x1f\x7f]', '', 'g'), 256) AS label FROM {documents}")
def sanitize_labels(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.clean_label(F.col("text")).alias("label"))


@query(f"SELECT id FROM ({NODES}) n WHERE contains(lower(label), 'customer#00000001') OR lower(id) = 'customer#00000001'")
def find_node(t: Tables) -> DataFrame:
    from tessera.operators.analyze import find_node as find

    return find(t.nodes, "CUSTOMER#00000001").select("id")


@query(f"SELECT id, CAST(contains(lower(label), 'ring') AS DOUBLE) + CAST(contains(lower(label), 'red') AS DOUBLE) + CAST(contains(lower(source_file), 'ring') AS DOUBLE) / 2 + CAST(contains(lower(source_file), 'red') AS DOUBLE) / 2 AS score FROM ({NODES}) n WHERE contains(lower(label), 'ring') OR contains(lower(label), 'red') OR contains(lower(source_file), 'ring') OR contains(lower(source_file), 'red')")
def node_keyword_score(t: Tables) -> DataFrame:
    from tessera.operators.analyze import keyword_score

    return keyword_score(t.nodes, ["ring", "Red"])


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[greatest(3 - 2, 1) : 3 + 2], chr(10)) AS snippet FROM {documents}")
def snippets(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.snippet(F.col("text"), F.lit(3), 2).alias("snippet"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS short FROM {documents}")
def truncate_content(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.shortened(F.col("text")).alias("short"))


@query(r"SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CAST(i + 9 AS STRING) || ' | ' || x), chr(10)) AS body FROM {documents}")
def numbered_lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.numbered(F.col("text"), F.lit(10)).alias("body"))


@query("SELECT doc_id, sha256(concat_ws(chr(0), '2', text, source)) AS file_hash FROM {documents}")
def file_hashes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", V.file_hash(2, F.col("text"), F.col("source")).alias("file_hash"))


#: Addresses of repositories in each form, and other texts.
ADDRESSED = """SELECT page_id, 'o' || CAST(page_id % 9 AS STRING) AS owner, 'r.' || CAST(page_id AS STRING) AS repo, CASE page_id % 7 WHEN 0 THEN 'https://h/' WHEN 1 THEN 'git@h:' WHEN 2 THEN 'https://h/' WHEN 3 THEN 'git@h:' WHEN 4 THEN 'https://h/' WHEN 5 THEN 'https://h/' END AS before,
  CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '.git' WHEN 3 THEN '.git' WHEN 4 THEN '/' WHEN 5 THEN '.git/' END AS after, 'page ' || url AS url FROM {pages}"""


@query(f"SELECT page_id, CASE WHEN before IS NULL THEN replace(replace(replace(url, '/', '-'), ':', '-'), '.git', '') ELSE owner || '-' || repo END AS slug, before IS NOT NULL AS address FROM ({ADDRESSED}) a")
def url_slugs(t: Tables) -> DataFrame:
    url = F.coalesce(F.concat("before", "owner", F.lit("/"), "repo", "after"), "url")
    return t.sql(ADDRESSED).select("page_id", V.slug_of(url).alias("slug"), V.is_address(url).alias("address"))


@query(f"SELECT source_file, list_sort(list(id)) AS ids FROM ({NODES}) n GROUP BY 1")
def semantic_cache_groups(t: Tables) -> DataFrame:
    return incremental.by_source(t.nodes)


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 11 = 0 THEN 'changed' WHEN doc_id % 13 = 0 THEN 'deleted' ELSE 'unchanged' END AS state FROM {documents}")
def incremental_split(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.length("text").alias("mtime"))
    new = d.where(~((F.col("doc_id") % 13 == 0) & (F.col("doc_id") % 7 != 0) & (F.col("doc_id") % 11 != 0))).withColumn("mtime", F.when(F.col("doc_id") % 11 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return incremental.split(d.where("doc_id % 7 <> 0"), new, "doc_id")


@query(f"SELECT DISTINCT path FROM ({FILES}) f WHERE doc_id % 7 = 0 OR doc_id % 13 = 0 OR doc_id % 11 = 0 UNION SELECT 'old/' || CAST(doc_id AS STRING) FROM {{documents}} WHERE doc_id % 11 = 0 AND doc_id % 2 = 0")
def changed_paths(t: Tables) -> DataFrame:
    f = t.files
    fed = f.where("doc_id % 11 = 0").select(F.when(F.col("doc_id") % 2 == 0, "R").otherwise("C").alias("status"), "path", F.concat(F.lit("old/"), F.col("doc_id").cast("string")).alias("old_path"))
    return incremental.changed_paths(f.where("doc_id % 13 <> 0 OR doc_id % 7 = 0"), f.where("doc_id % 7 <> 0"), fed)


@query(f"SELECT path, start_line FROM ({CHUNKS}) c WHERE path NOT IN (SELECT path FROM ({FILES}) f WHERE doc_id % 11 = 0) AND path IN (SELECT path FROM ({FILES}) f WHERE doc_id % 7 <> 0)")
def copy_unchanged(t: Tables) -> DataFrame:
    prior = t.chunks.join(t.files.where("doc_id % 7 <> 0").select("path"), "path", "left_semi")
    return incremental.reusable(prior, t.chunks, t.files.where("doc_id % 11 = 0")).select("path", *big("start_line"))


@query("SELECT doc_id, doc_id % 3 = 0 AS hit, CASE WHEN doc_id % 3 = 0 THEN lang END AS result FROM {documents}")
def semantic_cache_split(t: Tables) -> DataFrame:
    files = t.documents.select("doc_id", V.digest(F.col("doc_id")).alias("file_hash"))
    cache = t.documents.where("doc_id % 3 = 0").select(V.digest(F.col("doc_id")).alias("file_hash"), F.col("lang").alias("result"))
    return incremental.cache_split(files, cache).select("doc_id", "hit", "result")


@query("SELECT event_id FROM {events} WHERE event_type IN ('purchase', 'error') AND ts < (SELECT max(ts) FROM {events}) - INTERVAL '3600' SECOND")
def expired_jobs(t: Tables) -> DataFrame:
    jobs = t.events.select("event_id", F.col("event_type").alias("status"), F.col("ts").alias("completed_at"))
    return incremental.expired(jobs, F.lit(t.events.agg(F.max("ts")).first()[0]), 3600, ("purchase", "error")).select("event_id")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'other content' END AS problem FROM {documents} WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def snapshot_mismatches(t: Tables) -> DataFrame:
    want = t.documents.select("doc_id", V.content_hash(F.col("text")).alias("hash"))
    have = t.documents.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(V.content_hash(F.col("text"))).alias("hash"), F.lit("d").alias("document"), F.array(F.lit(1.0)).alias("embedding"))
    return incremental.mismatches(want, have, "doc_id")


@query("SELECT url, CAST(len(regexp_extract_all(html, '<p')) AS BIGINT) AS paragraphs, CAST(length(html) AS BIGINT) AS size FROM {pages}")
def html_documents(t: Tables) -> DataFrame:
    return t.pages.select("url", F.size(F.regexp_extract_all("html", F.lit("<p"), F.lit(0))).cast("long").alias("paragraphs"), F.length("html").cast("long").alias("size"))


@query("SELECT source AS slug, count(*) AS n FROM {documents} GROUP BY 1 ORDER BY 1 LIMIT 5 OFFSET 5")
def repo_page(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.col("source").alias("slug")).agg(F.count("*").alias("n")).orderBy("slug").offset(5).limit(5)


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S') AS stamp FROM {events}")
def generation_stamps(t: Tables) -> DataFrame:
    s = V.stamp(F.col("ts"))
    back = F.date_format(V.stamp_time(s), "yyyyMMdd'T'HHmmss")
    return t.events.select("event_id", back.alias("stamp"))


@query("SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 6) AS norm FROM {embeddings}")
def vector_norms(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", r6(V.dot(F.col("embedding"), F.col("embedding")), "norm"))
