"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm import additive, license, mixing, multi_index, ngram_join, packing, ppm, quality, spelling, substring, toxicity, warc, whitening
from quizloom.llm.common import fold

WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "language": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 2, "src1": 3}}
BUDGET_SHARE, EPOCHS = 0.6, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain() -> Column:
    """Sources fall into three domains by their number."""
    return F.concat(F.lit("d"), (F.expr("try_cast(regexp_extract(source, '[0-9]+', 0) as int)") % 3).cast("string"))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), domain(), BUDGET_SHARE, EPOCHS, WEIGHTS, seed="7")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn=quality.learnable())
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return quality.with_score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"), k=3, percent=90)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_score(docs, table(spark, sf_dir, "labels"), learn=toxicity.learnable())
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_model, op2_revisits, op3_mixing, op4_packing, op5_quality, op6_substring, op7_nearest, op8_license, op9_multi_index, op10_ngram_join,
        op11_whitening, op12_toxicity, op13_spelling,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _base32() -> str:
    letter = f"substr('{warc.ALPHABET}', ((('0x' || substr(h, %d, 5))::BIGINT >> %d) & 31)::INTEGER + 1, 1)"
    return " || ".join(letter % (at + 1, s) for at in range(0, 40, 5) for s in (15, 10, 5, 0))


def _weight(level: str) -> str:
    return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in WEIGHTS[level].items()) + " ELSE 1 END"


def _level(of: str, by: str, name: str, given: str) -> str:
    """Children of each parent in order of room by weight; a child after the first that can't be filled gets its cut."""
    part = f"PARTITION BY {by}" if by else ""
    order = f"({part} ORDER BY room / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    rest = f"({part} ORDER BY room / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""
      SELECT * EXCLUDE (ok, l, o, a, filled, ahead, w), CASE WHEN ok OR a IS NULL THEN room ELSE ((l * (ahead - a + weight)) // o - (l * (ahead - a)) // o)::BIGINT END AS share
      FROM (SELECT *, min(CASE WHEN NOT ok THEN ahead END) OVER ({part}) AS a,
                   max(CASE WHEN NOT ok THEN greatest({given} - filled, 0) END) OVER ({part}) AS l,
                   max(CASE WHEN NOT ok THEN w END) OVER ({part}) AS o
            FROM (SELECT *, room * w <= greatest({given} - filled, 0) * weight AS ok
                  FROM (SELECT *, coalesce(sum(room) OVER {order}, 0) AS filled, coalesce(sum(weight) OVER {order}, 0) AS ahead,
                               sum(weight) OVER {rest} AS w FROM ({of}))))"""


_MIXING = f"""
WITH docs AS (SELECT doc_id, coalesce('d' || (try_cast(regexp_extract(source, '[0-9]+') AS INTEGER) % 3), '') AS domain,
                     coalesce(lang, '') AS language, coalesce(source, '') AS source, len({_WORDS}) AS n_tokens FROM documents),
leaves AS (SELECT domain, language, source, sum(n_tokens)::HUGEINT AS total, sum(n_tokens)::HUGEINT * {EPOCHS} AS room, ({_weight("source")})::HUGEINT AS weight
           FROM docs GROUP BY ALL HAVING total > 0),
languages AS (SELECT domain, language, sum(room)::HUGEINT AS room, ({_weight("language")})::HUGEINT AS weight FROM leaves GROUP BY ALL),
domains AS (SELECT domain, sum(room)::HUGEINT AS room, ({_weight("domain")})::HUGEINT AS weight, (SELECT floor(sum(n_tokens) * {BUDGET_SHARE}::DOUBLE)::HUGEINT FROM docs) AS given FROM languages GROUP BY ALL),
d AS ({_level("SELECT * FROM domains", "", "domain", "given")}),
l AS ({_level("SELECT x.*, d.share AS given FROM languages x JOIN d USING (domain)", "domain", "language", "given")}),
s AS ({_level("SELECT x.*, l.share AS given FROM leaves x JOIN l USING (domain, language)", "domain, language", "source", "given")}),
chosen AS (SELECT doc_id, domain, language, source, n_tokens, share // total AS passes, share % total AS rest,
                  md5(concat_ws(':', '7', (share // total)::VARCHAR, doc_id::VARCHAR)) AS o FROM docs JOIN s USING (domain, language, source)),
placed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM chosen)
SELECT doc_id, domain, language, source, n_tokens::BIGINT AS n_tokens, passes::BIGINT AS passes, greatest(0, least(n_tokens, rest - start))::BIGINT AS prefix_tokens
FROM placed WHERE passes > 0 OR greatest(0, least(n_tokens, rest - start)) > 0
"""


def _canonical(text: str) -> str:
    out = f"regexp_replace(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ{license.MARKS}', 'abcdefghijklmnopqrstuvwxyz{' ' * len(license.MARKS)}'), '\\r\\n?', chr(10), 'g')"
    for pattern, replacement in license.EQUIVALENT:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    out = f"regexp_replace({out}, '{license.COPYRIGHT_LINE.replace('(?md)', '(?m)')}', '', 'g')"
    return f"trim(regexp_replace({out}, '{license.PUNCTUATION}', ' ', 'g'), ' ')"


def _crc_table() -> list[int]:
    """crc32 of single bytes, by its rule: a division of polynomials over bits."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


_KNOWN = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in license.KNOWN)

SQL = {
    "op2_revisits": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_base32()} AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM m""",
    "op3_mixing": _MIXING,
    "op6_substring": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(gone.p) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL), '') AS k
         FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_license": f"""
WITH known AS (SELECT min(license) AS license, known_digest FROM (SELECT license, sha256({_canonical("t")}) AS known_digest FROM (VALUES {_KNOWN}) AS k(license, t)) GROUP BY known_digest),
d AS (SELECT doc_id, sha256({_canonical("text")}) AS canonical_digest FROM documents)
SELECT doc_id, canonical_digest, license FROM d LEFT JOIN known ON canonical_digest = known_digest""",
    "op10_ngram_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+2], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_sides AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_sides JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, min(reach.b))::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id""",
    "op13_spelling": rf"""
WITH RECURSIVE r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[{spelling.LETTERS}]{{7,}}')) AS run FROM documents) GROUP BY ALL),
bytes AS (SELECT *, [{", ".join(map(str, _crc_table()))}]::BIGINT[] AS t, coalesce(doc_id::VARCHAR, '') || ':' || run AS x FROM r),
hashed AS (SELECT run, n, xor(list_reduce([4294967295] || [('0x' || substr(hex(encode(x)), 2 * i + 1, 2))::BIGINT FOR i IN range(strlen(x))], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN run[:(h % length(run))::INTEGER] || run[(h % length(run))::INTEGER + 2:] ELSE run END AS word FROM hashed) GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2),
less AS (SELECT word, n, p, word[:p] || word[p + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM w)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM less a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN w b ON a.rest = b.word),
counted AS (SELECT word, count(*) AS n_near, max(n) AS m FROM near GROUP BY word),
best AS (SELECT word, any_value(n_near) AS n_near, any_value(m) AS m, min(other) FILTER (WHERE near.n = m) AS other FROM counted JOIN near USING (word) GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, coalesce(form, word) AS root, 0 AS step FROM forms UNION ALL SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON chain.root = forms.word WHERE forms.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(root, step) FROM chain WHERE chain.word = forms.word) AS root, n, n_near, form_n FROM forms""",
}
