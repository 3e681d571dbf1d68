"""Queries of the text operators on the driver's tables, with their oracles."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from lattica.functions import ids
from lattica.functions.query import guard, parse
from lattica.functions.tokenize import code_tokens, whole_tokens
from lattica.operators import search as S
from lattica.operators import verbs as VB
from lattica.plans import fixtures as X
from lattica.plans import oracle_views as V
from lattica.plans.registry import query
from lattica.schema import VerbError

TOKENS = r"string_split_regex(lower(regexp_replace(regexp_replace({0}, '([\p{{Lu}}])([\p{{Lu}}][\p{{Ll}}])', '\1 \2', 'g'), '([^\p{{Lu}}])([\p{{Lu}}])', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+')"
WORDS = ("the", "tion", "king")
DOCS = "docs AS (SELECT 'docs.example/corpus/' || source AS repo, 'file:' || lang || '/' || doc_id || '.txt' AS node_id, doc_id || '.txt' AS name, lang || '/' || doc_id || '.txt' AS path, text AS content FROM documents),\n"
TOKS = DOCS + f"toks AS (SELECT repo, node_id, tok FROM (SELECT repo, node_id, unnest({TOKENS.format('content')}) AS tok FROM docs) WHERE tok <> ''),\n"
BM25 = TOKS + """dl AS (SELECT d.repo, d.node_id, count(t.tok) AS dl FROM docs d LEFT JOIN toks t USING (repo, node_id) GROUP BY ALL),
st AS (SELECT repo, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY repo),
tf AS (SELECT repo, node_id, tok, count(*) AS tf FROM toks WHERE tok IN ('the', 'are', 'which') GROUP BY ALL),
df AS (SELECT repo, tok, count(*) AS df FROM tf GROUP BY ALL),
score AS (SELECT repo, node_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (repo, tok) JOIN dl USING (repo, node_id) JOIN st USING (repo) GROUP BY repo, node_id)"""
CLAUSES = parse("the are which")
BODY = {"content": 1.0}


@query("t_code_tokens", f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_filter({TOKENS.format('text')}, lambda x: x <> '') AS t FROM documents)")
def t_code_tokens(spark, d):
    rows = X.table(spark, d, "documents").select("doc_id", code_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query("t_whole_tokens", r"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents)")
def t_whole_tokens(spark, d):
    rows = X.table(spark, d, "documents").select("doc_id", whole_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


GUARDED = ("rate limit", "(a", "((((((((a))))))))", "(((((((((a)))))))))", "a [b TO c]", "x IN [a b]", "{a TO b}", "age:>5", "a -> b", "a < b", '"[quoted]"', " ", "x" * 1025)


@query("t_query_guard", "SELECT * FROM (VALUES (0, true), (1, true), (2, true), (3, false), (4, false), (5, true), (6, false), (7, false), (8, true), (9, false), (10, true), (11, false), (12, false)) t(n, ok)")
def t_query_guard(spark, d):
    def ok(q: str) -> bool:
        try:
            guard(q)
        except VerbError:
            return False
        return True

    return spark.createDataFrame([(i, ok(q)) for i, q in enumerate(GUARDED)], "n int, ok boolean")


@query("t_plain_snippet", "SELECT item_id, text || ' & <x> \"y\"' AS plain FROM benchmark")
def t_plain_snippet(spark, d):
    html = F.concat(F.lit("<b>"), F.col("text"), F.lit("</b> &amp; &lt;x&gt; &quot;y&quot;"))
    return X.table(spark, d, "benchmark").select("item_id", ids.plain_snippet(html).alias("plain"))


def body_scores(spark, d):
    return S.bm25(X.index(spark, d), CLAUSES, BODY).drop("kind")


@query("t_bm25", f"WITH {BM25} SELECT repo, node_id, round(score, 6) AS score FROM score")
def t_bm25(spark, d):
    return body_scores(spark, d).select("repo", "node_id", F.round("score", 6).alias("score"))


NORM = f"WITH {BM25}, norm AS (SELECT repo, node_id, round(score / max(score) OVER (PARTITION BY repo), 6) AS score FROM score)"


@query("t_normalize", f"{NORM} SELECT repo, node_id, score FROM norm")
def t_normalize(spark, d):
    return S.normalize(body_scores(spark, d), 6)


@query("t_topk", f"WITH {BM25} SELECT repo, node_id FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY round(score, 6) DESC, node_id) AS r FROM score) WHERE r <= 10")
def t_topk(spark, d):
    return S.top_k(body_scores(spark, d).withColumn("score", F.round("score", 6)), 10).select("repo", "node_id")


@query("t_merge_page", f"{NORM} SELECT repo, node_id, score, rank, total > 40 AS has_more FROM (SELECT *, row_number() OVER (ORDER BY score DESC, repo, node_id) AS rank, count(*) OVER () AS total FROM norm) WHERE rank BETWEEN 21 AND 40")
def t_merge_page(spark, d):
    return S.merge_page(S.normalize(body_scores(spark, d), 6), 20, 20).withColumn("rank", F.col("rank").cast("long"))


@query("t_window_clamp", "SELECT o_orderkey AS n, o_orderkey % 1200 + 20 <= 1000 AS ok FROM orders")
def t_window_clamp(spark, d):
    return X.table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), (F.col("o_orderkey") % 1200 + 20 <= S.MAX_OFFSET).alias("ok"))


WHOLE = r"string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+')"
COLUMN = "CASE split_part(field, '_', 1) WHEN 'name' THEN name WHEN 'path' THEN path ELSE content END"
SPLIT = f"list_filter(CASE WHEN suffix(field, '_whole') THEN {WHOLE.format(COLUMN)} ELSE {TOKENS.format(COLUMN)} END, lambda x: x <> '')"
SEARCH = f"""WITH {DOCS} f(field, boost) AS (VALUES ('name', 3.0), ('path', 1.0), ('content', 1.0), ('name_whole', 3.0), ('path_whole', 1.0), ('content_whole', 1.0)),
ft AS MATERIALIZED (SELECT repo, node_id, field, boost, {SPLIT} AS t FROM docs, f),
st AS (SELECT repo, field, count(*) AS n, avg(len(t)) AS avgdl FROM ft GROUP BY ALL),
tf AS MATERIALIZED (SELECT repo, node_id, field, boost, len(t) AS dl, w, len(list_filter(t, lambda x: x = w)) AS tf FROM ft, (SELECT unnest(['the', 'txt', 'which']) AS w)),
hit AS (SELECT *, count(*) OVER (PARTITION BY repo, field, w) AS df FROM tf WHERE tf > 0),
score AS (SELECT repo, node_id, sum(CASE WHEN w <> 'which' THEN boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END) AS score, bool_or(w = 'the') AND NOT bool_or(w = 'which') AS must FROM hit JOIN st USING (repo, field) GROUP BY repo, node_id),
norm AS (SELECT repo, node_id, round(score / max(score) OVER (PARTITION BY repo), 6) AS score FROM score WHERE must)
SELECT repo, node_id, score, row_number() OVER (ORDER BY score DESC, repo, node_id) AS rank FROM norm ORDER BY rank LIMIT 20"""


@query("t_search", SEARCH)
def t_search(spark, d):
    return S.search(X.index(spark, d), "+the txt -which").select("repo", "node_id", "score", F.col("rank").cast("long").alias("rank"))


ALL_HITS = SEARCH.replace(")\nSELECT repo, node_id, score, row_number() OVER (ORDER BY score DESC, repo, node_id) AS rank FROM norm ORDER BY rank LIMIT 20", """),
top AS (SELECT * FROM norm QUALIFY row_number() OVER (PARTITION BY repo ORDER BY score DESC, node_id) <= 1000)
SELECT (rank - 1) // 300 AS page, repo, node_id, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, repo, node_id) AS rank FROM top) WHERE rank <= 1000""")


@query("t_search_pages", ALL_HITS)
def t_search_pages(spark, d):
    """All pages of a search over all repositories; what is found is written once, and one of them is published anew after the first page."""
    index, catalog = X.index(spark, d), VB.Catalog()
    for r in index.stats.select("repo").collect():  # some dozens
        catalog.put(r["repo"], "r1", None, index)
    engine, pages, cursor = VB.Engine(catalog, b"a key of the fixture's"), [], None
    while not pages or cursor:
        rows, cursor = engine.search("+the txt -which", limit=300, cursor=cursor)
        pages.append(rows.select(F.lit(len(pages)).cast("long").alias("page"), "repo", "node_id", "score", F.col("rank").cast("long").alias("rank")))
        catalog.put("docs.example/corpus/src1", "r2", None, index._replace(blocks=index.blocks.limit(0)))
    return reduce(lambda a, b: a.unionByName(b), pages)


@query("t_snippets")
def t_snippets(spark, d):
    return S.search(X.index(spark, d), "the").select("node_id", "snippet")


def symbol_docs(spark, d):
    p = X.parts(spark, d)
    return p.select(F.lit(X.REPO).alias("repo"), F.col("symbol_id").alias("node_id"), F.lit("Symbol").alias("kind"), "name", "path", F.lit("").alias("content"))


@query("t_kind_filter", V.graph("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM nodes WHERE kind IN ('Symbol', 'Package') GROUP BY kind"))
def t_kind_filter(spark, d):
    return S.kind_filter(X.nodes(spark, d), ["Symbol", "Package"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("t_symbols_named", f"WITH {V.PARTS} SELECT name, symbol_id AS node_id, path, total > 256 AS unaddressable FROM (SELECT *, count(*) OVER (PARTITION BY name) AS total FROM p) WHERE name IN ('small_ring', 'red_widget') AND contains(path, 'brand1')")
def t_symbols_named(spark, d):
    names = spark.createDataFrame([("small_ring",), ("red_widget",), ("nothing",)], "name string")
    return S.symbols_named(symbol_docs(spark, d), names, F.lit("brand1"))


@query("t_fuzzy", f"WITH {V.PARTS}, q AS (SELECT DISTINCT name FROM p UNION ALL SELECT 'nothing'), c AS (SELECT name, count(*) AS n FROM p GROUP BY name) SELECT q.name, CASE WHEN n IS NULL THEN 'no_such_symbol' WHEN n > 256 THEN 'unaddressable' WHEN n = 1 THEN 'exact' ELSE 'ambiguous' END AS outcome, coalesce(n, 0) AS total, CASE WHEN n = 1 THEN 1.0 WHEN n BETWEEN 2 AND 256 THEN 0.9::DOUBLE / n END AS confidence, CASE WHEN n BETWEEN 2 AND 256 THEN (SELECT string_agg(symbol_id, ' ' ORDER BY symbol_id) FROM (SELECT symbol_id FROM p WHERE p.name = q.name ORDER BY symbol_id LIMIT 25)) END AS candidates FROM q LEFT JOIN c USING (name)")
def t_fuzzy(spark, d):
    docs = symbol_docs(spark, d)
    names = docs.select("name").distinct().unionByName(spark.createDataFrame([("nothing",)], "name string"))
    return S.fuzzy(docs, names).withColumn("candidates", F.array_join("candidates", " "))


@query("t_set_equal", "SELECT o_orderkey, o_orderkey % 3 <> 2 AS same FROM orders")
def t_set_equal(spark, d):
    a = F.array(F.lit("b"), F.lit("a"), F.lit("a"))
    b = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("b"), F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a")))
    norm = lambda x: F.array_sort(F.array_distinct(x))
    return X.table(spark, d, "orders").select("o_orderkey", (norm(a) == norm(b)).alias("same"))


@query("x_search_docs", V.graph("SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN kind = 'File' THEN length(name) ELSE 0 END) AS BIGINT) AS chars FROM nodes WHERE kind IN ('Symbol', 'File') GROUP BY kind"))
def x_search_docs(spark, d):
    nodes = X.nodes(spark, d).withColumn("repo", F.lit(X.REPO))
    bodies = nodes.where("kind = 'File'").select(F.col("id").alias("node_id"), F.col("name").alias("content"))
    return S.search_docs(nodes, bodies).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


#: What each name of a repository is asked with.
KINDS = {"ok": None, "no_kind": [], "unknown_kind": ["Fil"], "a_kind": ["File"]}


@query("t_vocabulary", """WITH r AS (SELECT DISTINCT 'docs.example/corpus/' || source AS repo, true AS there FROM documents UNION ALL SELECT DISTINCT 'docs.example/corpus/' || lang, false FROM documents)
SELECT repo, k AS kinds, CASE WHEN k IN ('no_kind', 'unknown_kind') THEN 'bad_request' WHEN there THEN 'ok' ELSE 'not_found' END AS outcome FROM r, (VALUES ('ok'), ('no_kind'), ('unknown_kind'), ('a_kind')) t(k)""")
def t_vocabulary(spark, d):
    """Asks every repository of the index, and as many names as there are languages, which are of none."""
    index, docs = X.index(spark, d), X.table(spark, d, "documents")
    names = [r[0] for c in ("source", "lang") for r in docs.select(F.concat(F.lit("docs.example/corpus/"), c)).distinct().collect()]  # some dozens
    found = S.known(index, names)

    def outcome(kinds, repo: str) -> str:
        try:
            S.validate("the", kinds, [repo])
            S.refuse_unknown([repo], found)
        except VerbError as e:
            return e.code
        return "ok"

    return spark.createDataFrame([(r, k, outcome(v, r)) for r in names for k, v in KINDS.items()], "repo string, kinds string, outcome string")


#: Words and phrases of the queries below: tokens in the code fields, in the _whole fields.
LEAVES = {
    "the": ("the", "the"), "txt": ("txt", "txt"), "which": ("which", "which"), "are": ("are", "are"), "of": ("of", "of"), "king": ("king", "king"), "und": ("und", "und"), "des": ("des", "des"),
    "of_the": ("of the", "of the"), "is_on": ("is on", "is on"), "of_the_by": ("of the by", "of the by"), "isOn": ("is on", "ison"),
}
#: query, whether a document matches (m), its score (s): written apart from the parser. m(x) and s(x) are of the leaves above.
ASKED = (
    ("(the OR of) AND are", "({the} OR {of}) AND {are}", "s.the + s.of + s.are"),
    ("are -(the of)", "{are} AND NOT ({the} OR {of})", "s.are"),
    ("the AND of OR und", "({the} AND {of}) OR {und}", "if({the} AND {of}, s.the + s.of, 0) + s.und"),
    ("the AND of und", "({the} AND {of}) OR {und}", "if({the} AND {of}, s.the + s.of, 0) + s.und"),
    ("+the txt -which", "{the} AND NOT {which}", "s.the + s.txt"),
    ("(the AND NOT (of are)) OR (des king)", "({the} AND NOT ({of} OR {are})) OR {des} OR {king}", "if({the} AND NOT ({of} OR {are}), s.the, 0) + s.des + s.king"),
    ("content:the^2 des", "m.the.content OR {des}", "2 * coalesce(s.the_content, 0) + s.des"),
    ("(the of)^3 king", "{the} OR {of} OR {king}", "3 * (s.the + s.of) + s.king"),
    ("body:IN [king which] +are", "{are}", "s.are + if(m.king.content OR m.which.content, 1, 0)"),
    ("+content:IN [king which]^0.5 are", "m.king.content OR m.which.content", "0.5 + s.are"),
    ('"of the"', "{of_the}", "s.of_the"),
    ('isOn -"of the"', "{isOn} AND NOT {of_the}", "s.isOn"),
    ('+"is on" "of the by" (which)', "{is_on}", "s.is_on + s.of_the_by + s.which"),
    ("NOT which AND the", "{the} AND NOT {which}", "s.the"),
    ("*^2 -the", "NOT {the}", "2.0"),
    ("kind:File +und", "{und}", "s.und + s.file"),
    ("+(+the +are) +(des OR which)", "{the} AND {are} AND ({des} OR {which})", "s.the + s.are + s.des + s.which"),
)


def _asked() -> str:
    leaf = lambda text: re.sub(r"\{(\w+)\}", r"m.\1.any", text)
    score = lambda text: re.sub(r"s\.(\w+?)_content", r"s.\1.content", re.sub(r"s\.(\w+)(?<!_content)\b(?!_)", r"coalesce(s.\1.any, 0)", leaf(text)))
    return "\nUNION ALL ".join(f"SELECT {i} AS q, repo, node_id, {score(s)} AS score FROM w WHERE {leaf(m)}" for i, (_, m, s) in enumerate(ASKED))


def _leaf_rows(docs: str, each: str, leaves: str) -> str:
    """Views up to w: a row a document with structs m and s, which for each leaf have any and content."""
    return f"""WITH {docs} f(field, boost) AS (VALUES ('name', 3.0), ('path', 1.0), ('content', 1.0), ('name_whole', 3.0), ('path_whole', 1.0), ('content_whole', 1.0)),
ft AS MATERIALIZED (SELECT repo, node_id, field, boost, {each} AS t FROM docs, f),
st AS (SELECT repo, field, count(*) AS n, avg(len(t)) AS avgdl FROM ft GROUP BY ALL),
lf(leaf, code, whole) AS (VALUES {leaves}),
lw AS (SELECT leaf, field, string_split(CASE WHEN suffix(field, '_whole') THEN whole ELSE code END, ' ') AS ws FROM lf, f),
tok AS MATERIALIZED (SELECT repo, node_id, field, w, pos FROM (SELECT repo, node_id, field, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM ft) WHERE w IN (SELECT unnest(ws) FROM lw)),
df AS (SELECT repo, field, w, count(DISTINCT node_id) AS df FROM tok GROUP BY ALL),
hit AS (SELECT a.repo, a.node_id, leaf, a.field, len(ws) AS size, count(*) AS tf FROM lw JOIN tok a ON a.field = lw.field AND a.w = ws[1] LEFT JOIN tok b ON b.repo = a.repo AND b.node_id = a.node_id AND b.field = a.field AND b.w = ws[2] AND b.pos = a.pos + 1
  LEFT JOIN tok c ON c.repo = a.repo AND c.node_id = a.node_id AND c.field = a.field AND c.w = ws[3] AND c.pos = a.pos + 2 WHERE (len(ws) < 2 OR b.pos IS NOT NULL) AND (len(ws) < 3 OR c.pos IS NOT NULL) GROUP BY ALL),
idf AS (SELECT repo, leaf, field, sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM (SELECT leaf, field, unnest(ws) AS w FROM lw) JOIN df USING (field, w) JOIN st USING (repo, field) GROUP BY ALL),
sc AS (SELECT repo, node_id, leaf, field, boost * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avgdl)) AS score FROM hit JOIN idf USING (repo, leaf, field) JOIN ft USING (repo, node_id, field) JOIN st USING (repo, field)),
by_leaf AS (SELECT repo, node_id, leaf, sum(score) AS score, sum(score) FILTER (field = 'content') AS content FROM sc GROUP BY ALL),"""


def _wide() -> str:
    rows = ", ".join(f"('{k}', '{c}', '{w}')" for k, (c, w) in LEAVES.items())
    pick = lambda k, c: f"max(l.{c}) FILTER (leaf = '{k}')"
    m = ", ".join(f"'{k}': {{'any': coalesce({pick(k, 'score')}, 0) > 0, 'content': coalesce({pick(k, 'content')}, 0) > 0}}" for k in LEAVES)
    s = ", ".join(f"'{k}': {{'any': {pick(k, 'score')}, 'content': {pick(k, 'content')}}}" for k in LEAVES)
    return f"{_leaf_rows(DOCS, SPLIT, rows)}\nw AS MATERIALIZED (SELECT d.repo, d.node_id, {{{m}}} AS m, {{{s}, 'file': {{'any': max(ln(1 + 0.5 / (n_repo + 0.5)))}}}} AS s FROM docs d JOIN (SELECT repo, count(*) AS n_repo FROM docs GROUP BY repo) USING (repo) LEFT JOIN by_leaf l ON l.repo = d.repo AND l.node_id = d.node_id GROUP BY d.repo, d.node_id),"


@query("t_boolean", f"""{_wide()}
r AS ({_asked()}),
norm AS (SELECT q, repo, node_id, round(score / max(score) OVER (PARTITION BY q, repo), 6) AS score FROM r)
SELECT q, repo, node_id, score FROM norm""")
def t_boolean(spark, d):
    """Every query with all its matches."""
    index = X.index(spark, d)
    each = [S.normalize(S.bm25(index, parse(text)), 6).select(F.lit(i).alias("q"), "repo", "node_id", "score") for i, (text, _, _) in enumerate(ASKED)]
    return reduce(lambda a, b: a.unionByName(b), each)


PHRASES = ("of the", "the by", "rateLimit", "is on the", "thEof", "en le la")


@query("t_phrases", "WITH " + DOCS + f"""p(phrase, ws) AS (VALUES ('of the', ['of', 'the']), ('the by', ['the', 'by']), ('rateLimit', ['rate', 'limit']), ('is on the', ['is', 'on', 'the']), ('thEof', ['th', 'eof']), ('en le la', ['en', 'le', 'la'])),
tok AS MATERIALIZED (SELECT node_id, w, pos FROM (SELECT node_id, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM (SELECT node_id, list_filter({TOKENS.format("content")}, lambda x: x <> '') AS t FROM docs)) WHERE w IN (SELECT unnest(ws) FROM p))
SELECT phrase, a.node_id, count(*) AS n FROM p JOIN tok a ON a.w = ws[1] JOIN tok b ON b.node_id = a.node_id AND b.w = ws[2] AND b.pos = a.pos + 1 LEFT JOIN tok c ON c.node_id = a.node_id AND c.w = ws[3] AND c.pos = a.pos + 2 WHERE len(ws) < 3 OR c.pos IS NOT NULL GROUP BY ALL""")
def t_phrases(spark, d):
    index = X.index(spark, d)
    each = [S.phrase_counts(index, p, "content").select(F.lit(p).alias("phrase"), "node_id", "n") for p in PHRASES]
    return reduce(lambda a, b: a.unionByName(b), each)
