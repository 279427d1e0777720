"""Queries over texts: scalars, predicates, tokens and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusmill.functions import text as T
from locusmill.functions import tokens as K
from locusmill.operators import similarity
from locusmill.operators.spans import sums_of
from locusmill.plans.registry import query, table

#: The cut of a clause for engines without look-around: the mark and the connective as two groups.
_CUT = K.CLAUSE_CUT.removeprefix("(?i)").replace(r"[,;]\s+(?=", r"([,;]\s+)(").replace(r"\b)", r"\b)")
_READABLE = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<\s*/?\s*(?:sup|sub|em|strong|i|b)\s*>', ' ', 'gi'), '&nbsp;', ' ', 'gi'), '\s+', ' ', 'g'))"
_PROSE = r"""lower(trim(regexp_replace(translate(regexp_replace(coalesce(text, ''), '([A-Za-z])-\s*\n\s*([A-Za-z])', '\1\2', 'g'), '‘’“”', '''''""'), '\s+', ' ', 'g')))"""


@query(f"SELECT doc_id, {_READABLE} AS readable FROM documents")
def readable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.readable("text").alias("readable"))


@query(f"SELECT doc_id, {_PROSE} AS prose FROM documents")
def normal_prose_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normal_prose("text", composed=True).alias("prose"))


@query(rf"SELECT doc_id, regexp_replace(lower({_READABLE}), '[\s\p{{P}}\p{{S}}]+', '', 'g') AS compact FROM documents")
def coverage_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.compact_cjk("text").alias("compact"))


@query(r"SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]', '', 'g') AS key FROM documents")
def letter_digit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.letters_and_digits("text", composed=True).alias("key"))


@query(rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower({_READABLE}), '\s+', '', 'g'), '.') AS c FROM documents),
k AS (SELECT doc_id, list_transform(range(1, len(c) + 1), lambda i: CASE
  WHEN contains('。！？!?,，、;；:：“”「」『』（）()[]{{}}【】', c[i])
    THEN CASE WHEN coalesce(regexp_matches(c[i - 1], '\p{{N}}'), false) AND coalesce(regexp_matches(c[i + 1], '\p{{N}}'), false) THEN c[i] ELSE '' END
  WHEN contains('‘’"''', c[i])
    THEN CASE WHEN coalesce(regexp_matches(c[i - 1], '\p{{N}}'), false) OR coalesce(regexp_matches(c[i + 1], '\p{{N}}'), false) THEN c[i] ELSE '' END
  ELSE c[i] END) AS kept FROM t)
SELECT doc_id, array_to_string(kept, '') AS key FROM k
""")
def coverage_text_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.coverage_key("text").alias("key"))


@query(rf"""
SELECT doc_id, CAST(len(tok) AS BIGINT) AS n_tokens, md5(array_to_string(tok, ' ')) AS tokens_md5 FROM (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(replace({_PROSE}, chr(173), ''), '‐‑−–', '----'), '([+-])\s+(\d)', '\1\2', 'g'),
    '[\p{{L}}][\p{{L}}\p{{N}}]*|[+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:e[+-]?\d+)?|[<>=≤≥≠±]') AS tok FROM documents)
""")
def scientific_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", K.science_tokens("text", composed=True).alias("tok"))
    return docs.select("doc_id", F.size("tok").cast("bigint").alias("n_tokens"), F.md5(F.array_join("tok", " ")).alias("tokens_md5"))


@query(rf"""
SELECT doc_id, CAST(a AS BIGINT) AS latin, CAST(c AS BIGINT) AS cjk, a >= 20 AND c <= greatest(2, a * 0.03) AS english FROM (
  SELECT doc_id, len(regexp_extract_all({_READABLE}, '[A-Za-z]')) AS a, len(regexp_extract_all({_READABLE}, '[\x{{3400}}-\x{{9fff}}]')) AS c FROM documents)
""")
def english_like_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.readable("text").alias("text"))
    latin, cjk = T.latin_letters("text").cast("bigint"), T.cjk_letters("text").cast("bigint")
    return docs.select("doc_id", latin.alias("latin"), cjk.alias("cjk"), T.mostly_english("text").alias("english"))


@query(r"""
WITH u AS (SELECT page_id, url, url || '&api_key=1&x=10.1234/AB-' || page_id || '.' AS noisy FROM pages)
SELECT page_id, split_part(url, '#', 1) AS address,
  lower(regexp_replace(regexp_extract(noisy, '10\.\d{4,9}/[-._;()/:A-Za-z0-9]+'), '[.)]+$', '')) AS doi,
  'https://doi.org/10.1234/ab-' || page_id AS doi_address,
  CASE WHEN contains(url, '#') THEN url || '&api_key=1' ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'k=2' END AS public
FROM u
""")
def doi_and_url_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat("url", F.lit("&api_key=1&x=10.1234/AB-"), key, F.lit(".")).alias("noisy"))
    secret = F.when(F.contains("url", F.lit("#")), F.concat("url", F.lit("&api_key=1"))).when(
        F.contains("url", F.lit("?")), F.concat("url", F.lit("&access_token=1&k=2"))
    ).otherwise(F.concat("url", F.lit("?access_token=1&k=2")))
    return pages.select(
        "page_id", T.page_address("url").alias("address"), T.found_doi("noisy").alias("doi"),
        T.article_address(F.lit(""), F.concat(F.lit("doi: 10.1234/ab-"), key)).alias("doi_address"), T.public_address(secret).alias("public"),
    )


@query(r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  NOT regexp_matches(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), 'just a moment|access denied|captcha|are you a robot')
  AND len(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[A-Za-z]')) >= 20 AS usable
FROM pages
""")
def usable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    robot = F.regexp_like(F.lower(title), F.lit("just a moment|access denied|captcha|are you a robot"))
    words = T.latin_letters(F.regexp_replace("html", "<[^>]*>", " ")) >= 20
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), (~robot & words).alias("usable"))


_ALL_SENTENCES = rf"list_filter(list_transform(regexp_extract_all({_READABLE}, '[^.!?]+[.!?]+'), lambda s: trim(s)), lambda s: length(s) >= 8)"
_ALL_WINDOWS = """
w AS (SELECT doc_id, s, unnest(range(2, 6)) AS size FROM s),
x AS (SELECT doc_id, s, size, unnest(range(0, len(s) - size + 1)) AS start FROM w WHERE len(s) >= size),
runs AS (SELECT doc_id, CAST(size AS INTEGER) AS size, CAST(start AS INTEGER) AS start, array_to_string(s[start + 1 : start + size], ' ') AS text FROM x)
"""


#: The lines of a document are its paragraphs.
_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL)"


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


@query(f"""
WITH {_LINES}, s AS (SELECT doc_id, line, {_ALL_SENTENCES} AS s FROM l), w AS (SELECT doc_id, line, s, unnest(range(2, 6)) AS size FROM s),
x AS (SELECT doc_id, line, s, size, unnest(range(0, len(s) - size + 1)) AS start FROM w WHERE len(s) >= size)
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(size AS INTEGER) AS size, CAST(start AS INTEGER) AS start, array_to_string(s[start + 1 : start + size], ' ') AS text FROM x
""")
def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows within a paragraph; those of ``whole_sentence_windows`` go over its end."""
    said = _paragraphs(spark, sf_dir).select("doc_id", "line", K.plain_sentences(T.readable("text")).alias("s"))
    return said.select("doc_id", "line", F.inline(K.windows(F.col("s"))))


@query(f"WITH s AS (SELECT doc_id, {_ALL_SENTENCES} AS s FROM documents), {_ALL_WINDOWS} SELECT doc_id, size, start, text FROM runs")
def whole_sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", K.plain_sentences(T.readable("text")).alias("s"))
    return docs.select("doc_id", F.inline(K.windows(F.col("s"))))


_SHORTLIST = f"""
{_LINES}, s AS (SELECT doc_id, line, {_READABLE} AS p, {_ALL_SENTENCES} AS s FROM l),
c AS (SELECT DISTINCT doc_id, line, p, s[2] AS chosen, unnest(s) AS cand FROM s WHERE len(s) >= 3),
r AS (SELECT doc_id, line, chosen, cand, floor((2 * abs((strpos(p, cand) - 1 + length(cand) / 2.0) / length(p) - (strpos(p, chosen) - 1 + length(chosen) / 2.0) / length(p))
    + 0.35 * abs(length(cand) - greatest(24, length(chosen))) / greatest(24, length(chosen))) * 1e9 + 0.5) / 1e9 AS penalty FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY penalty, cand) AS place FROM r),
top AS (SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(place AS INTEGER) AS place, chosen, cand AS candidate, penalty FROM k WHERE place <= 6)
"""


@query(f"WITH {_SHORTLIST} SELECT doc_id, line, place, candidate, penalty FROM top")
def mapping_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each paragraph the six sentences that fit best by place and length to its second, which stands for a selection."""
    return _shortlisted(spark, sf_dir).drop("chosen")


def _shortlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _paragraphs(spark, sf_dir).select("doc_id", "line", T.readable("text").alias("p"))
    docs = docs.select("doc_id", "line", "p", K.plain_sentences(F.col("p")).alias("s"))
    # An outer explode of nothing where there are too few: filters would go below what makes the sentences, and make them again.
    docs = docs.select("doc_id", "line", "p", F.get("s", F.lit(1)).alias("chosen"), F.explode_outer(F.when(F.size("s") >= 3, F.array_distinct("s"))).alias("cand")).where("cand is not null")
    penalty = similarity.position_penalty(F.col("p"), F.col("chosen"), F.col("p"), F.col("cand"))
    order = W.partitionBy("doc_id", "line").orderBy("penalty", "cand")
    ranked = docs.select("doc_id", "line", "chosen", "cand", T.halves_up(penalty, 9).alias("penalty")).withColumn("place", F.row_number().over(order))
    return ranked.where("place <= 6").select("doc_id", "line", "place", "chosen", F.col("cand").alias("candidate"), "penalty")


_DICE = rf"""
{_SHORTLIST}, k2 AS (SELECT doc_id, line, place, regexp_replace(lower(chosen), '[^\p{{L}}\p{{N}}]', '', 'g') AS a, regexp_replace(lower(candidate), '[^\p{{L}}\p{{N}}]', '', 'g') AS b FROM top),
ga AS (SELECT doc_id, line, place, gram, count(*) AS n FROM (SELECT doc_id, line, place, unnest(list_transform(range(1, length(a)), lambda i: a[i : i + 1])) AS gram FROM k2) GROUP BY ALL),
gb AS (SELECT doc_id, line, place, gram, count(*) AS n FROM (SELECT doc_id, line, place, unnest(list_transform(range(1, length(b)), lambda i: b[i : i + 1])) AS gram FROM k2) GROUP BY ALL),
o AS (SELECT doc_id, line, place, sum(least(ga.n, gb.n)) AS o FROM ga JOIN gb USING (doc_id, line, place, gram) GROUP BY ALL),
dice AS (SELECT doc_id, line, place, floor((CASE WHEN a = '' OR b = '' THEN 0
    WHEN contains(a, b) OR contains(b, a) THEN 0.65 + 0.35 * least(length(a), length(b)) / greatest(length(a), length(b))
    ELSE 2.0 * coalesce(o, 0) / greatest(1, length(a) + length(b) - 2) END) * 1e6 + 0.5) / 1e6 AS score FROM k2 LEFT JOIN o USING (doc_id, line, place))
"""


@query(f"WITH {_DICE} SELECT doc_id, line, place, score FROM dice")
def bigram_dice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection of each paragraph against its own shortlist; no other pairs arise."""
    pairs = _shortlisted(spark, sf_dir)
    key = lambda c: T.letters_and_digits(c, composed=True)
    pairs = pairs.select("doc_id", "line", "place", key("chosen").alias("a"), key("candidate").alias("b"))
    return similarity.bigram_scored(pairs, "a", "b").drop("a", "b")


@query(f"""
WITH {_DICE}, m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY score DESC, place) AS k, lead(score) OVER (PARTITION BY doc_id, line ORDER BY score DESC, place) AS second FROM dice)
SELECT doc_id, line, place, score, coalesce(second, 0) AS second, score >= 0.78 AND round(score - coalesce(second, 0), 6) >= 0.1 AS accepted FROM m WHERE k = 1
""")
def margin_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.best_by_margin(bigram_dice_pairs(spark, sf_dir), ["doc_id", "line"], "place", "score")


@query(rf"""
WITH s AS (SELECT doc_id, {_READABLE} AS p, {_ALL_SENTENCES} AS s FROM documents), {_ALL_WINDOWS},
c AS (SELECT doc_id, string_split(regexp_replace(x, '([,;]\s+)((?:which|where|whereas|however|these|this|they|it|although|while|but|and)\b)', '\1' || chr(1) || '\2', 'gi'), chr(1)) AS c
  FROM (SELECT doc_id, unnest(s) AS x FROM s)),
i AS (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM c),
j AS (SELECT doc_id, c, i, unnest(range(i, len(c) + 1)) AS j FROM i),
a AS (SELECT doc_id, p AS cand FROM s UNION SELECT doc_id, unnest(s) FROM s UNION SELECT doc_id, trim(array_to_string(c[i:j], '')) FROM j UNION SELECT doc_id, text FROM runs),
r AS (SELECT doc_id, cand, floor((2 * abs((greatest(strpos(p, cand) - 1, 0) + length(cand) / 2.0) / length(p) - (strpos(p, chosen) - 1 + length(chosen) / 2.0) / length(p))
    + 0.35 * abs(length(cand) - greatest(24, length(chosen))) / greatest(24, length(chosen))) * 1e9 + 0.5) / 1e9 AS penalty
  FROM (SELECT doc_id, p, s[2] AS chosen, cand FROM s JOIN a USING (doc_id) WHERE len(s) >= 3 AND length(cand) >= 8)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY penalty, cand) AS place FROM r)
SELECT doc_id, CAST(place AS INTEGER) AS place, cand AS candidate, penalty FROM k WHERE place <= 6
""")
def whole_mapping_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.readable("text").alias("p"))
    docs = docs.select("doc_id", "p", K.plain_sentences(F.col("p")).alias("s")).where(F.size("s") >= 3)

    # What candidates share is a column of its own, measured once a document and not once a candidate.
    docs = docs.withColumn("size", F.length("p")).withColumn("chosen", F.col("s")[1])
    docs = docs.withColumn("center", similarity.center(F.col("p"), F.col("chosen"), F.col("size"))).withColumn("wanted", F.greatest(F.lit(24), F.length("chosen")))
    by_size = lambda c: 0.35 * F.abs(F.length(c) - F.col("wanted")) / F.col("wanted")

    def ranked(candidate: Column) -> Column:
        penalty = 2 * F.abs(similarity.center(F.col("p"), candidate, F.col("size")) - F.col("center")) + by_size(candidate)
        return F.struct(T.halves_up(penalty, 9).alias("penalty"), candidate.alias("candidate"))

    # The sixth best of some candidates is a bound: one whose length alone costs more can't be among the best six, and is neither made nor looked for.
    runs = lambda s: F.transform(K.windows(s), lambda w: w["text"])
    some = F.filter(F.array_distinct(F.concat(F.array("p"), F.slice("s", 1, 60), runs(F.slice("s", 1, 6)))), lambda c: F.length(c) >= 8)
    docs = docs.withColumn("some", some).withColumn("most", F.get(F.array_sort(F.transform("some", ranked)), F.lit(5))["penalty"] + 1e-6).drop("some")
    slack = F.col("wanted") * F.col("most") / 0.35 + 1
    docs = docs.withColumn("low", F.coalesce(F.col("wanted") - slack, F.lit(0.0))).withColumn("high", F.coalesce(F.col("wanted") + slack, F.col("size") + 1.0))
    docs = docs.withColumn("pieces", F.transform("s", K.clauses))
    docs = docs.withColumn("parts", F.transform("pieces", lambda c: F.struct(c.alias("pieces"), sums_of(F.transform(c, lambda x: F.length(x).cast("bigint"))).alias("before")))).drop("pieces")
    spans = F.flatten(F.transform("parts", lambda c: K.sized_spans(c, F.col("low"), F.col("high"))))
    fits = lambda c: (F.length(c) >= 8) & F.length(c).between(F.col("low"), F.col("high"))
    near = F.array_distinct(F.filter(F.concat(F.array("p"), "s", spans, runs(F.col("s"))), fits))
    docs = docs.withColumn("near", near).select("doc_id", "p", "size", "center", "wanted", "near")
    # Ranked inside the row: candidates are many times the text, and only the first six leave it.
    best = F.slice(F.array_sort(F.transform("near", ranked)), 1, 6)
    placed = docs.select("doc_id", F.posexplode(best).alias("place", "best"))
    return placed.select("doc_id", (F.col("place") + 1).alias("place"), "best.candidate", "best.penalty")


@query(f"SELECT doc_id, {_PROSE} AS prose FROM documents")
def nfkc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no text that NFKC changes, so plain SQL gives the same; tests hold others against Python."""
    return table(spark, sf_dir, "documents").select("doc_id", T.normal_prose("text").alias("prose"))


def _american_sql(text: str) -> str:
    for british, form in T.SPELLINGS.items():
        text = rf"regexp_replace({text}, '\b{british}\b', '{form}', 'g')"
    return text


_DIGIT = "coalesce(regexp_matches({}, '^[0-9]$'), false)"


@query(rf"""
WITH t AS (SELECT doc_id, {_american_sql(rf"translate(regexp_replace(replace({_PROSE}, chr(173), ''), '{T.NUMERIC_CITATION}', '', 'g'), '‐‑−–', '----')")} AS t FROM documents),
c AS (SELECT doc_id, regexp_extract_all(t, '(?s).') AS c FROM t),
k AS (SELECT doc_id, list_transform(range(1, len(c) + 1), lambda i: CASE
  WHEN regexp_matches(c[i], '[\p{{L}}\p{{N}}<>=≤≥≠±]') THEN c[i]
  WHEN c[i] IN ('+', '-') AND ({_DIGIT.format("c[i + 1]")} OR (c[i + 1] = ' ' AND {_DIGIT.format("c[i + 2]")})) THEN c[i]
  WHEN c[i] = '.' AND {_DIGIT.format("c[i + 1]")} AND ({_DIGIT.format("c[i - 1]")} OR ((i = 1 OR c[i - 1] = ' ')
    AND NOT regexp_matches(array_to_string(c[greatest(1, i - 9) : i - 1], ''), '(?:\.|\b(?:fig|eq|no|vol|pp|sect))\s*$'))) THEN c[i]
  ELSE '' END) AS kept FROM c)
SELECT doc_id, array_to_string(kept, '') AS compact FROM k
""")
def compact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.compact_science("text").alias("compact"))


@query(rf"""
SELECT doc_id, regexp_replace({_american_sql(_PROSE.replace("coalesce(text, '')", "(text || ' analysed signalling 54–56.')"))}, '\s*54–56\.$', '54,55,56.') AS canonical FROM documents
""")
def canonical_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    prose = T.normal_prose(F.concat("text", F.lit(" analysed signalling 54–56.")), composed=True)
    return table(spark, sf_dir, "documents").select("doc_id", T.expanded_citations(T.american(prose)).alias("canonical"))


@query(rf"""
WITH s AS (SELECT doc_id, {_ALL_SENTENCES} AS s FROM documents),
e AS (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS sentence FROM s),
c AS (SELECT doc_id, sentence, string_split(regexp_replace(x, '{_CUT}', '\1' || chr(1) || '\2', 'gi'), chr(1)) AS c FROM e),
i AS (SELECT doc_id, sentence, c, unnest(range(1, len(c) + 1)) AS i FROM c),
j AS (SELECT doc_id, sentence, c, i, unnest(range(i, len(c) + 1)) AS j FROM i)
SELECT doc_id, CAST(sentence AS INTEGER) AS sentence, CAST(row_number() OVER (PARTITION BY doc_id, sentence ORDER BY i, j) - 1 AS INTEGER) AS span,
  trim(array_to_string(c[i:j], '')) AS text FROM j
""")
def clause_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(K.plain_sentences(T.readable("text"))).alias("sentence", "s"))
    return docs.select("doc_id", "sentence", F.posexplode(K.clause_spans(F.col("s"))).alias("span", "text"))
