"""One query for each operator, and the same in DuckDB's SQL.

All queries run over whole tables. Queries that sort give a rank column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import process, text
from .operators import dictionary as dic
from .operators import pages as pg
from .operators import punkt, report, spelling, tagging
from .plans.tables import ensure_checkpoint_dir
from .sources.adapters import pages_from_conversations, pages_from_documents

Query = Callable[[SparkSession, str], DataFrame]

#: Word lists that the queries use.
ONLY = ["the", "and", "edhe", "of the"]
IGNORE = ["the", "of", "and the"]
LISTED = ["The", "and", "of", "to", "ing", "der", "die"]
FREQ_CUT = 20


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.processed(pages_from_documents(_read(spark, sf_dir, "documents")))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("text"))


def _counts(spark: SparkSession, sf_dir: str, overall: bool = False) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return report.page_counts(pg.with_overall(pages) if overall else pages)


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus frequencies that need no order: straight from the texts."""
    return report.corpus_counts(_clean(spark, sf_dir))


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.first_seen(_counts(spark, sf_dir, overall=True))


def _trained(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return dic.train(_read(spark, sf_dir, table))


def _step(name: str) -> Query:
    return lambda s, d: _read(s, d, "documents").select("doc_id", text.clean(F.col("text"), name).alias("text"))


def _process(step) -> Query:
    return lambda s, d: _clean(s, d).select("doc_id", step(F.col("text")).alias("text"))


def _bench_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select("item_id", text.clean(F.col("text")).alias("text"))


def _spell_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.shrink(_trained(spark, sf_dir), FREQ_CUT)


def _suggested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions for all words of the texts, which are counted once."""
    ensure_checkpoint_dir(spark)
    words = _trained(spark, sf_dir).checkpoint()
    return spelling.suggestions(words, dic.shrink(words, FREQ_CUT))


def _report(change) -> Query:
    return lambda s, d: change(_corpus(s, d))


def _ranked_words(change) -> Query:
    return lambda s, d: change(_seen(s, d)).select("word", "freq")


def _within(spark: SparkSession, sf_dir: str, scope: str, limit: str) -> DataFrame:
    """The report of each page or file, limited within it."""
    if scope == "page":
        return report.frequency(report.page_counts(_pages(spark, sf_dir), limit), scope)
    ensure_checkpoint_dir(spark)
    found = report.frequency(_counts(spark, sf_dir), scope, first=True).checkpoint()
    return report.limited_within(found, report.SCOPES[scope], limit).drop("first_seen")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their tags in context, under a lexicon learned from the same texts."""
    return tagging.tag_rows(_clean(spark, sf_dir), "doc_id", tagging.learned(_corpus(spark, sf_dir)))


def _chain(c):
    """Digits, case, then ignored words, in the order of the processing steps."""
    return process.ignore(F.lower(process.strip_digits(process.strip_punctuation(c))), IGNORE)


QUERIES: dict[str, Query] = {
    "pages_default": lambda s, d: pg.fields(_pages(s, d)),
    "pages_fields_npfwt": lambda s, d: pg.fields(_pages(s, d), "npfwt"),
    "pages_selected_1_2_11_14": lambda s, d: pg.fields(pg.selected(_pages(s, d), "1 2 11-14"), "pfw"),
    "pages_custom_field": lambda s, d: pg.fields(pg.with_overall(_pages(s, d)), "pfc", "Project-7-File-@-p#-$"),
    "page_numbers_overall": lambda s, d: pg.with_overall(_pages(s, d)).select("file_path", "page_no", "page_no_overall"),
    "conversation_pages": lambda s, d: pg.fields(pg.processed(pages_from_conversations(_read(s, d, "conversations"))), "pfwt"),
    "files_natural_order": lambda s, d: pg.file_order(_pages(s, d)),
    "clean_whitespace": _step("whitespace"),
    "clean_fold": _step("fold"),
    "clean_dehyphenate": _step("dehyphenate"),
    "clean_symbols": _step("symbols"),
    "clean_spaced_letters": _step("spaced_letters"),
    "clean_spacing": _step("spacing"),
    "clean_common_splits": _step("common_splits"),
    "clean_text": _step("trim"),
    "page_word_count": lambda s, d: _clean(s, d).select("doc_id", F.size(text.words(F.col("text"))).alias("word_count")),
    "page_sentence_count": lambda s, d: _clean(s, d).select("doc_id", F.size(text.sentences(F.col("text"))).alias("sentence_count")),
    "tokenize_sentences": lambda s, d: pg.sentence_rows(_pages(s, d)),
    "punkt_statistics": lambda s, d: punkt.statistics(_clean(s, d)).withColumn("score", F.round("score", 2) + F.lit(0.0)),
    "punkt_collocations": lambda s, d: punkt.collocations(_clean(s, d)).withColumn("score", F.round("score", 2) + F.lit(0.0)),
    "tokenize_sentences_trained": lambda s, d: punkt.sentence_rows(_clean(s, d), "doc_id"),
    "file_text": lambda s, d: pg.file_text(_pages(s, d)),
    "tokenize_words": lambda s, d: pg.word_rows(_pages(s, d)),
    "sentence_rows_raw": lambda s, d: pg.sentence_rows_raw(_pages(s, d).withColumn("text", process.strip_digits(F.lower("raw_text")))),
    "word_rows_raw": lambda s, d: pg.word_rows_raw(_pages(s, d).withColumn("text", process.strip_digits(F.col("raw_text")))),
    "file_stats": lambda s, d: pg.file_stats(_pages(s, d)),
    "corpus_stats": lambda s, d: pg.corpus_stats(_pages(s, d)),
    "freq_page": lambda s, d: report.frequency(_counts(s, d), "page"),
    "freq_file": lambda s, d: _read(s, d, "documents").select(F.col("source").alias("file_path"), F.explode_outer(text.counted_words(text.clean(F.col("text")))).alias("word")).where("word is not null").groupBy("file_path", "word").agg(F.count(F.lit(1)).alias("freq")),
    "freq_corpus": _corpus,
    "freq_corpus_last_wins": lambda s, d: report.last_wins(_counts(s, d, overall=True)),
    "freq_sorted_alpha": lambda s, d: report.ordered(_corpus(s, d), "alpha"),
    "freq_sorted_freq": lambda s, d: report.ordered(_seen(s, d), "freq"),
    "freq_chron": lambda s, d: report.ordered(_seen(s, d), "chron"),
    "freq_limit_pct_70": _ranked_words(lambda r: report.limited(r, "70%")),
    "freq_limit_pct_7": _ranked_words(lambda r: report.limited(r, "7%")),
    "freq_limit_top_100": _ranked_words(lambda r: report.limited(r, "100")),
    "freq_file_limit_pct_70": lambda s, d: _within(s, d, "file", "70%"),
    "freq_file_limit_top_100": lambda s, d: _within(s, d, "file", "100"),
    "freq_page_limit_top_10": lambda s, d: _within(s, d, "page", "10"),
    "freq_page_limit_pct_28": lambda s, d: _within(s, d, "page", "28%"),
    "freq_limit_min_50": _report(lambda r: report.limited(r, "50+")),
    "freq_only": _report(lambda r: report.only(r, LISTED)),
    "freq_ignore": _report(lambda r: report.ignored(r, LISTED)),
    "freq_stopwords": lambda s, d: report.ignored(_corpus(s, d), _stop_words()),
    "freq_pos": lambda s, d: tagging.tagged_frequency(_clean(s, d)),
    "pos_lexicon": lambda s, d: tagging.learned(_corpus(s, d)),
    "pos_tags": _tagged,
    "freq_pos_context": lambda s, d: tagging.context_frequency(_tagged(s, d)),
    "process_punctuation": _process(process.strip_punctuation),
    "process_digits": _process(process.strip_digits),
    "process_numeric_words": _process(process.drop_numeric_words),
    "process_lowercase": _process(F.lower),
    "process_only": _process(lambda c: process.only(c, ONLY)),
    "process_ignore": _process(lambda c: process.ignore(c, IGNORE)),
    "process_chain": _process(_chain),
    "process_stopwords": _process(lambda c: process.ignore(c, _stop_words())),
    "process_only_stopwords": _process(lambda c: process.only(c, _stop_words())),
    "autocorrect": lambda s, d: spelling.autocorrected(_bench_rows(s, d), "item_id", _spell_dictionary(s, d)),
    "autocorrect_remove": lambda s, d: spelling.autocorrected(_bench_rows(s, d), "item_id", _spell_dictionary(s, d), remove=True),
    "remove_unknown": lambda s, d: spelling.known_only(_clean(s, d), "doc_id", _spell_dictionary(s, d)),
    "corrections": lambda s, d: spelling.correction_log(_bench_rows(s, d), "item_id", _spell_dictionary(s, d)).withColumn("confidence", F.round("confidence", 6)),
    "spelling_suggest": lambda s, d: spelling.suggestions(dic.train(_read(s, d, "benchmark")), _spell_dictionary(s, d)).withColumn("confidence", F.round("confidence", 6)),
    "autocorrect_documents": lambda s, d: spelling.autocorrected(_clean(s, d), "doc_id", _spell_dictionary(s, d)),
    "autocorrect_remove_documents": lambda s, d: spelling.autocorrected(_clean(s, d), "doc_id", _spell_dictionary(s, d), remove=True),
    "corrections_documents": lambda s, d: spelling.correction_log(_clean(s, d), "doc_id", _spell_dictionary(s, d)).withColumn("confidence", F.round("confidence", 6)),
    "spelling_suggest_documents": lambda s, d: _suggested_documents(s, d).withColumn("confidence", F.round("confidence", 6)),
    "lemmatize": lambda s, d: tagging.lemmatized(_clean(s, d), "doc_id", _trained(s, d)),
    "dict_train": lambda s, d: dic.train(_read(s, d, "documents")),
    "dict_merge": lambda s, d: dic.merge(_trained(s, d), _trained(s, d, "conversations")),
    "dict_shrink": lambda s, d: dic.shrink(dic.train(_read(s, d, "documents")), 5),
    "dict_cap": lambda s, d: dic.cap(dic.train(_read(s, d, "documents")), 5000),
    "dict_add": lambda s, d: dic.add(_trained(s, d), "a banana, A bandana the"),
    "dict_remove": lambda s, d: dic.remove(_trained(s, d), ["the 12", "And", "zzz"]),
}


def _stop_words() -> list[str]:
    from .sources.lists import stop_words

    return stop_words()


# The same in SQL. Names below hold SQL text.

_P = text.PUNCTUATION.replace("'", "''")


def _steps(source: str, key: str, value: str = "text") -> str:
    """CTEs c1 to c9 with the cleaning steps, over a table."""
    return f"""
c1 AS (SELECT {key}, regexp_replace(coalesce({value}, ''), '\\s', ' ', 'g') AS c FROM {source}),
c2 AS (SELECT {key}, strip_accents(replace(replace(c, 'ß', 'ss'), 'ẞ', 'SS')) AS c FROM c1),
c3 AS (SELECT {key}, regexp_replace(c, '[‘’‚‛′`]', '''', 'g') AS c FROM c2),
c4 AS (SELECT {key}, regexp_replace(c, '(\\S)-\\s+', '\\1', 'g') AS c FROM c3),
c5 AS (SELECT {key}, regexp_replace(c, '[^a-zA-Z0-9'' .;,"$/@!?&\\-()_]', '', 'g') AS c FROM c4),
c5s AS (SELECT {key}, string_split(c, ' ') AS l FROM c5),
c6 AS (SELECT {key}, array_to_string([l[i] || CASE WHEN i = len(l) OR (i + 1 < len(l) AND regexp_matches(l[i], '(^|\\W)\\w$') AND regexp_full_match(l[i + 1], '\\w')) THEN '' ELSE ' ' END FOR i IN range(1, len(l) + 1)], '') AS c FROM c5s),
c7 AS (SELECT {key}, regexp_replace(regexp_replace(c, '\\s+', ' ', 'g'), '\\s([.,;])', '\\1', 'g') AS c FROM c6),
c8 AS (SELECT {key}, regexp_replace(regexp_replace(c, '(?i)\\b(t)\\s?h\\s?e\\b', '\\1he', 'g'), '\\ba\\s?n\\s?d\\b', 'and', 'g') AS c FROM c7),
c9 AS (SELECT {key}, trim(c) AS c FROM c8)"""


def _pieces(c: str) -> str:
    """SQL for the pieces between white space, signs and contractions cut off."""
    x = f"regexp_replace({c}, '([^\\w\\s''.-])', ' \\1 ', 'g')"
    x = f"regexp_replace({x}, '\\.(\\s|$)', ' . \\1', 'g')"
    x = f"regexp_replace({x}, '(?i)\\b(can)(not)\\b', '\\1 \\2', 'g')"
    x = f"regexp_replace({x}, '(?i)(n''t)\\b', ' \\1', 'g')"
    return f"regexp_split_to_array(regexp_replace({x}, '(?i)(''s|''m|''d|''ll|''re|''ve)\\b', ' \\1', 'g'), '\\s+')"


def _split(c: str) -> str:
    """SQL for the list of words of a cleaned text."""
    return f"[CASE WHEN t[1] = '''' THEN t ELSE trim(t, '{_P}') END FOR t IN {_pieces(c)} IF trim(t, '{_P}') <> '']"


def _marked(c: str) -> str:
    """SQL for words and punctuation in order: a piece is cut where its word begins and ends."""
    cut = "regexp_extract_all(t, '^[^A-Za-z0-9]+|[A-Za-z0-9](?:.*[A-Za-z0-9])?|[^A-Za-z0-9]+$')"
    return f"flatten([CASE WHEN t[1] = '''' THEN [t] ELSE {cut} END FOR t IN {_pieces(c)} IF t <> ''])"


def _glued(value: str, where: str = "true") -> str:
    """SQL for text of tokens in the order of pos; those without letter or digit have no space before them."""
    return f"trim(coalesce(string_agg(CASE WHEN regexp_matches({value}, '[A-Za-z0-9]') THEN ' ' || {value} ELSE {value} END, '' ORDER BY pos) FILTER (WHERE {where}), ''))"


def _bare(t: str) -> str:
    return f"trim(lower({t}), '{_P}')"


def _sentences(c: str) -> str:
    return f"[s FOR s IN string_split(regexp_replace({c}, '([.!?]+[\"'')]*)\\s+', '\\1' || chr(1), 'g'), chr(1)) IF trim(s) <> '']"


_NATURAL = "regexp_replace(regexp_replace({0}, '(\\d+)', '00000000000000000000\\1', 'g'), '\\d*(\\d{{20}})', '\\1', 'g')"
_DOC = "WITH " + _steps("documents", "doc_id, source, lang")
_PAGES = _DOC + """,
w AS (SELECT doc_id, source, c, """ + _split("c") + """ AS words FROM c9),
f AS (SELECT source AS file, row_number() OVER (ORDER BY """ + _NATURAL.format("source") + """, source) AS file_ord FROM (SELECT DISTINCT source FROM documents)),
p AS (SELECT w.*, file_ord, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS page_no,
      row_number() OVER (ORDER BY file_ord, doc_id) AS overall FROM w JOIN f ON source = file)"""
_EACH = _PAGES + f""",
e AS (SELECT source, page_no, overall, file_ord, {_bare('t')} AS word, i FROM (SELECT source, page_no, overall, file_ord, unnest(words) AS t, unnest(range(1, len(words) + 1)) AS i FROM p)),
n AS (SELECT word, count(*) AS freq, min({{'a': file_ord, 'b': page_no, 'c': i}}) AS first FROM e WHERE word <> '' GROUP BY word)"""
_CORPUS = _DOC + f""",
n AS (SELECT word, count(*) AS freq FROM (SELECT {_bare('t')} AS word FROM (SELECT unnest({_split('c')}) AS t FROM c9)) WHERE word <> '' GROUP BY word)"""


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.lower().replace("'", "''") + "'" for w in words)


def _upto(n: str) -> str:
    return f"{_DOC} SELECT doc_id, c AS text FROM {n}"


def _percent(p: int) -> str:
    return f"""{_EACH}, r AS (SELECT *, coalesce(sum(freq) OVER (ORDER BY freq DESC, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(freq) OVER () AS total FROM n)
SELECT word, freq FROM r WHERE before < ceil({p}::DOUBLE / 100 * total)"""


def _scoped(keys: str, limit: str) -> str:
    """SQL for reports by keys: of each the words whose running count, or running sum, is under the limit."""
    seen = f"{_EACH}, q AS (SELECT source AS file_path, {keys}, word, count(*) AS freq, min({{'b': page_no, 'c': i}}) AS first FROM e WHERE word <> '' GROUP BY ALL)"
    by = "PARTITION BY file_path" + (", page_no" if keys == "page_no" else "")
    before = "sum(freq)" if limit.endswith("%") else "count(*)"
    bound = f"ceil({limit[:-1]}::DOUBLE / 100 * total)" if limit.endswith("%") else limit
    shown = "file_path, page_no, word, freq" if keys == "page_no" else "file_path, word, freq"
    return f"{seen}, r AS (SELECT *, coalesce({before} OVER ({by} ORDER BY freq DESC, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(freq) OVER ({by}) AS total FROM q) SELECT {shown} FROM r WHERE before < {bound}"


def _loglik(k: str, n: str, p: str) -> str:
    return f"(CASE WHEN {k} = 0 THEN 0.0 ELSE {k} * ln({p}) END + CASE WHEN {n} - {k} = 0 THEN 0.0 ELSE ({n} - {k}) * ln(1 - {p}) END)"


def _punkt() -> str:
    """CTEs with the statistics of types (stat), pairs (col) and tokens (tk)."""
    kind = "regexp_replace(regexp_replace(lower({0}), '^[^a-z0-9]+', ''), '\\.$', '')"
    letters, whole = "length(replace(type, '.', ''))", "CAST(n_period + n_bare AS DOUBLE)"
    ratio = f"2 * ({_loglik('n_period::DOUBLE', whole, '0.99::DOUBLE')} - {_loglik('n_period::DOUBLE', whole, 'p')})"
    rest = "(total - a)"
    score = f"-2 * ({_loglik('k', 'a', '(b / total)')} + {_loglik('(b - k)', rest, '(b / total)')} - {_loglik('k', 'a', '(k / a)')} - {_loglik('(b - k)', rest, '((b - k) / greatest(total - a, 1.0))')})"
    return f"""{_DOC}, tk0 AS (SELECT doc_id, unnest(l) AS t, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, [x FOR x IN string_split(c, ' ') IF x <> ''] AS l FROM c9)),
tk AS (SELECT doc_id, t, i, {kind.format('t')} AS type, lead({kind.format('t')}) OVER (PARTITION BY doc_id ORDER BY i) AS following, t LIKE '%.' AS dot, regexp_matches(t, '^[^A-Za-z0-9]*([A-Za-z]|[0-9]+)\\.$') AS initial FROM tk0),
n AS (SELECT type, CAST(count(*) FILTER (dot) AS BIGINT) AS n_period, CAST(count(*) FILTER (NOT dot) AS BIGINT) AS n_bare FROM tk GROUP BY type),
pp AS (SELECT least(greatest(sum(n_period)::DOUBLE / sum(n_period + n_bare)::DOUBLE, 1e-9), 1 - 1e-9) AS p FROM n),
stat AS (SELECT type, n_period, n_bare, CASE WHEN {letters} = 0 THEN 0.0 ELSE {ratio} * exp(-{letters}::DOUBLE) * (length(type) - {letters} + 1) * pow({letters}::DOUBLE, -n_bare::DOUBLE) END AS score FROM n, pp WHERE n_period > 0),
abb AS (SELECT *, score >= 0.3 AND regexp_matches(type, '[a-z]') AS abbreviation FROM stat),
pair AS (SELECT type, following, count(*) AS n FROM tk WHERE initial AND following IS NOT NULL GROUP BY ALL),
cnt AS (SELECT type, count(*)::DOUBLE AS b, (count(*) FILTER (initial))::DOUBLE AS a FROM tk GROUP BY type),
met AS (SELECT pair.type, pair.following, n, n::DOUBLE AS k, x.a AS a, y.b AS b, (SELECT count(*)::DOUBLE FROM tk) AS total FROM pair JOIN cnt x ON pair.type = x.type JOIN cnt y ON pair.following = y.type),
col AS (SELECT * FROM (SELECT type, following, n, {score} AS score FROM met WHERE k / a > b / total) WHERE score >= 7.88)"""


#: SQL for a text without its digits.
_DIGITLESS = "regexp_replace({0}, '\\d', '', 'g')"


def _page_fields(columns: str, where: str = "") -> str:
    return f"{_PAGES} SELECT {columns} FROM p {where}"


_FP, _FN, _PN, _WC, _TX, _RT = 'source AS "Source File Path"', 'source AS "Source File Name"', 'page_no AS "Page Number (File)"', 'CAST(len(words) AS INTEGER) AS "Word Count"', 'c AS "Text"', 'c AS "Raw Text"'


def _q(word: str) -> str:
    return word.replace("'", "''")


def _ignoring(c: str, words: Sequence[str] = IGNORE) -> str:
    for w in words:
        c = f"regexp_replace({c}, '(?i)\\b{_q(w)}\\b', '', 'g')"
    return f"trim(regexp_replace({c}, ' {{2,}}', ' ', 'g'))"


_NO_PUNCT = f"regexp_replace(array_to_string({_split('c')}, ' '), '[^\\w\\s''-]|_', '', 'g')"
_TRAIN = "SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS word FROM {0}) GROUP BY word"
_ALL = _TRAIN.format("documents")

# spelling: distinct words of the benchmark against the dictionary
_SPELL = f"""
d AS (SELECT word, freq FROM ({_ALL}) WHERE freq > {FREQ_CUT}),
u0 AS (SELECT DISTINCT word FROM ({{0}})),
u AS (SELECT word, array_to_string(list_sort(string_split(word, '')), '') AS letters, [substr(word, 1, i - 1) || substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2) FOR i IN range(1, length(word))] AS swaps FROM u0 WHERE length(word) > 1 AND word NOT IN (SELECT word FROM d)),
ds AS (SELECT word, freq, array_to_string(list_sort(string_split(word, '')), '') AS letters, [substr(word, 1, i - 1) || substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2) FOR i IN range(1, length(word))] AS swaps FROM d),
q0 AS (SELECT u.word, ds.word AS cand, u.letters AS ul, ds.letters AS cl, levenshtein(u.word, ds.word) AS lev FROM (SELECT *, length(word) + unnest([-2, -1, 0, 1, 2]) AS size FROM u) u JOIN ds ON u.size = length(ds.word)),
q1 AS (SELECT word, cand, lev FROM q0 WHERE lev <= 2 OR (lev = 3 AND levenshtein(ul, cl) <= 2) OR (lev = 4 AND ul = cl)),
q AS (SELECT q1.word, cand, lev, u.swaps AS us, ds.swaps AS cs, freq FROM q1 JOIN u ON q1.word = u.word JOIN ds ON cand = ds.word),
k AS (SELECT word, cand, freq, CASE WHEN lev <= 1 OR list_contains(us, cand) THEN 1
   WHEN lev <= 2 OR len([x FOR x IN us IF levenshtein(x, cand) <= 1]) > 0 OR len([x FOR x IN cs IF levenshtein(word, x) <= 1]) > 0 OR list_has_any(us, cs) THEN 2 END AS edits FROM q),
b AS (SELECT word, min(edits) AS edits FROM k WHERE edits IS NOT NULL GROUP BY word),
g AS (SELECT k.word, sum(freq) AS total, max({{{{'f': freq, 'c': cand}}}}) AS top FROM k JOIN b ON k.word = b.word AND k.edits = b.edits GROUP BY k.word),
s AS (SELECT u0.word, CASE WHEN g.word IS NOT NULL THEN top.c ELSE u0.word END AS correction, CASE WHEN g.word IS NOT NULL THEN top.f::DOUBLE / total WHEN length(u0.word) = 1 OR u0.word IN (SELECT word FROM d) THEN 1.0 ELSE 0.0 END AS confidence FROM u0 LEFT JOIN g ON u0.word = g.word)"""
def _spelled(table: str, key: str) -> str:
    """CTEs up to ``done``: every token of a table with its correction."""
    return "WITH " + _steps(table, key) + f""",
tok AS (SELECT {key}, unnest(words) AS token, unnest(range(0, len(words))) AS pos FROM (SELECT {key}, {_marked('c')} AS words FROM c9)),
kinds AS (SELECT *, CASE WHEN NOT regexp_matches(token, '[A-Za-z0-9]') THEN 'punctuation' WHEN NOT regexp_full_match(token, '[A-Za-z]+') THEN 'other' ELSE 'word' END AS kind FROM tok),
""" + _SPELL.format("SELECT lower(token) AS word FROM kinds WHERE kind = 'word'") + f""",
done AS (SELECT {key}, pos, token, kind, CASE WHEN kind <> 'word' THEN token WHEN token = upper(token) THEN upper(correction) WHEN token = upper(token[1]) || lower(token[2:]) THEN upper(correction[1]) || lower(correction[2:]) ELSE correction END AS correction,
  CASE kind WHEN 'punctuation' THEN -1.0 WHEN 'other' THEN -2.0 ELSE confidence END AS confidence FROM kinds LEFT JOIN s ON kind = 'word' AND s.word = lower(token))"""


def _joined(table: str, key: str, where: str) -> str:
    return f"{_spelled(table, key)} SELECT b0.{key}, {_glued('correction', where)} AS text FROM {table} b0 LEFT JOIN done ON b0.{key} = done.{key} GROUP BY b0.{key}"


def _logged(table: str, key: str) -> str:
    return f"{_spelled(table, key)} SELECT {key}, CAST(pos AS INTEGER) AS pos, token AS word, confidence > 0 AS attempted, CASE WHEN confidence > 0 THEN correction END AS correction, CASE WHEN confidence > 0 THEN round(confidence, 6) END AS confidence FROM done WHERE kind = 'word' AND lower(token) NOT IN (SELECT word FROM d)"


def _suggested(table: str) -> str:
    return "WITH " + _SPELL.format(_TRAIN.format(table).replace("{", "{{").replace("}", "}}")).lstrip() + " SELECT word, correction, round(confidence, 6) AS confidence FROM s"


def _tag_sql(t: str) -> str:
    out = f"CASE WHEN regexp_full_match({t}, '[0-9][0-9.,]*') THEN 'CD'"
    for name, members in tagging.LEXICON.items():
        out += f" WHEN lower({t}) IN ({_quoted(members)}) THEN '{name}'"
    for ending, name in tagging.ENDINGS:
        out += f" WHEN lower({t}) LIKE '%{ending}' AND length({t}) > {len(ending) + 2} THEN '{name}'"
    return out + f" WHEN regexp_matches({t}, '^[A-Z]') THEN 'NNP' ELSE 'NN' END"


def _learned_sql() -> str:
    """CTEs with corpus frequencies (n) and the lexicon learned from them (lex)."""
    forms = []
    for name, endings in tagging.VOTES.items():
        for e in endings:
            for more in ["", "e"] if e[0] in "aeiou" else [""]:
                forms.append(f"SELECT left(word, length(word) - {len(e)}) || '{more}' AS word, '{name}' AS pos, freq FROM n WHERE word LIKE '%{e}' AND length(word) > {len(e) + 1}")
    votes = ", ".join(f"coalesce(sum(freq) FILTER (pos = '{name}'), 0) AS {name}" for name in tagging.VOTES)
    return f"""{_CORPUS}, forms AS ({' UNION ALL '.join(forms)}), votes AS (SELECT word, {votes} FROM forms GROUP BY word),
best AS (SELECT word, CASE WHEN VB > JJ AND VB > NN THEN 'VB' WHEN JJ > VB AND JJ > NN THEN 'JJ' END AS pos FROM votes WHERE greatest(VB, JJ) >= 2),
lex AS (SELECT word, pos FROM best JOIN n USING (word) WHERE pos IS NOT NULL AND length(word) > 1 AND {_tag_sql('word')} = 'NN')"""


def _context_sql() -> str:
    """CTEs, the last of which (k) has words with their tags, a rule after the other by lag and lead."""
    first = _tag_sql("t")
    out = f"""{_learned_sql()}, k_t AS (SELECT doc_id, unnest(l) AS t, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS i FROM (SELECT doc_id, {_split('c')} AS l FROM c9)),
k_f AS (SELECT doc_id, t, i, {first} AS g FROM k_t), k0 AS (SELECT doc_id, t, i, CASE WHEN g = 'NN' THEN coalesce(pos, g) ELSE g END AS g FROM k_f LEFT JOIN lex ON lex.word = lower(t))"""
    for j, (old, new, places, near) in enumerate(tagging.RULES):
        beside = " OR ".join(f"coalesce({'lag' if p < 0 else 'lead'}(g, {abs(p)}) OVER w IN ({', '.join(repr(x) for x in near)}), false)" for p in places)
        out += f",\nk{j + 1} AS (SELECT doc_id, t, i, CASE WHEN g = '{old}' AND ({beside}) THEN '{new}' ELSE g END AS g FROM k{j} WINDOW w AS (PARTITION BY doc_id ORDER BY i))"
    return f"{out}, k AS (SELECT * FROM k{len(tagging.RULES)})"


def _lemma_sql() -> str:
    tries = []
    for c, rules in tagging.DETACHMENT.items():
        tries += [f"SELECT word, class, {i} AS i, substr(word, 1, length(word) - {len(e)}) || '{new}' AS lemma FROM v WHERE class = '{c}' AND word LIKE '%{e}' AND length(word) > {len(e)}" for i, (e, new) in enumerate(rules)]
    return f"""{_DOC}, tok AS (SELECT doc_id, unnest(words) AS token, unnest(range(0, len(words))) AS pos FROM (SELECT doc_id, {_marked('c')} AS words FROM c9)),
tags AS (SELECT doc_id, pos, lower(token) AS word, {_tag_sql('token')} AS tag FROM tok),
classes AS (SELECT doc_id, pos, word, CASE WHEN tag LIKE 'JJ%' THEN 'a' WHEN tag LIKE '%RB%' THEN 'r' WHEN tag LIKE 'VB%' THEN 'v' ELSE 'n' END AS class FROM tags),
v AS (SELECT DISTINCT word, class FROM classes), tries AS ({' UNION ALL '.join(tries)}), d AS ({_ALL}),
best AS (SELECT word, class, min_by(lemma, i) AS lemma FROM tries WHERE lemma IN (SELECT word FROM d) GROUP BY word, class),
made AS (SELECT doc_id, {_glued('coalesce(lemma, c.word)')} AS text FROM classes c LEFT JOIN best ON c.word = best.word AND c.class = best.class GROUP BY doc_id)
SELECT d0.doc_id, coalesce(made.text, '') AS text FROM documents d0 LEFT JOIN made ON d0.doc_id = made.doc_id"""


def oracle_sql() -> dict[str, str]:
    only = ", ".join(f"regexp_extract_all(c, '(?i)\\b{w}\\b')" for w in ONLY)
    chain = _ignoring(f"lower(regexp_replace({_NO_PUNCT}, '\\d', '', 'g'))")
    doc = lambda v: f"{_DOC} SELECT doc_id, {v} AS text FROM c9"
    return {
        "pages_default": _page_fields(", ".join([_FP, _PN, _WC, _TX, _RT])),
        "pages_fields_npfwt": _page_fields(", ".join([_FN, _FP, _PN, _WC, _TX])),
        "pages_selected_1_2_11_14": _page_fields(", ".join([_FP, _PN, _WC]), "WHERE page_no IN (1, 2) OR page_no BETWEEN 11 AND 14"),
        "pages_custom_field": _page_fields(f"{_FP}, {_PN}, 'Project-7-File-' || source || '-p' || page_no || '-' || overall AS \"Custom Text\""),
        "page_numbers_overall": _page_fields("source AS file_path, page_no, overall AS page_no_overall"),
        "conversation_pages": "WITH " + _steps("conversations", "conv_id, turn") + f" SELECT CAST(conv_id AS VARCHAR) AS \"Source File Path\", CAST(turn + 1 AS INTEGER) AS \"Page Number (File)\", CAST(len({_split('c')}) AS INTEGER) AS \"Word Count\", c AS \"Text\" FROM c9",
        "files_natural_order": f"SELECT row_number() OVER (ORDER BY {_NATURAL.format('source')}, source) AS file_ord, source AS file_path, n AS n_pages FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)",
        "clean_whitespace": _upto("c1"), "clean_fold": _upto("c2"), "clean_dehyphenate": _upto("c4"), "clean_symbols": _upto("c5"),
        "clean_spaced_letters": _upto("c6"), "clean_spacing": _upto("c7"), "clean_common_splits": _upto("c8"), "clean_text": _upto("c9"),
        "page_word_count": f"{_DOC} SELECT doc_id, CAST(len({_split('c')}) AS INTEGER) AS word_count FROM c9",
        "page_sentence_count": f"{_DOC} SELECT doc_id, CAST(len({_sentences('c')}) AS INTEGER) AS sentence_count FROM c9",
        "tokenize_sentences": f"{_PAGES}, z AS (SELECT source, page_no, {_sentences('c')} AS l FROM p), y AS (SELECT source, page_no, unnest(l) AS sentence, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS sentence_no FROM z) SELECT source AS file_path, page_no, sentence_no, CAST(len({_split('sentence')}) AS INTEGER) AS word_count, sentence FROM y",
        "punkt_statistics": f"{_punkt()} SELECT type, n_period, n_bare, round(score, 2) + 0.0::DOUBLE AS score, abbreviation FROM abb",
        "punkt_collocations": f"{_punkt()} SELECT type, following, n, round(score, 2) + 0.0::DOUBLE AS score FROM col",
        "tokenize_sentences_trained": f"""{_punkt()}, e AS (SELECT *, regexp_matches(t, '[.!?]+["'')]*$') AND NOT (dot AND (type IN (SELECT type FROM abb WHERE abbreviation) OR (coalesce((type, following) IN (SELECT (type, following) FROM col), false)))) AS ends FROM tk),
g AS (SELECT doc_id, t, i, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM e)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) AS INTEGER) AS sentence_no, string_agg(t, ' ' ORDER BY i) AS sentence FROM g GROUP BY doc_id, g""",
        "file_text": f"{_PAGES}, z AS (SELECT source, page_no, c, CAST(coalesce(sum(length(c) + 1) OVER (PARTITION BY source ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins FROM p) SELECT source AS file_path, begins // {pg.PART} AS part, string_agg(c, ' ' ORDER BY page_no) AS text FROM z GROUP BY ALL",
        "sentence_rows_raw": f"{_PAGES}, z AS (SELECT source, page_no, {_sentences(_DIGITLESS.format('lower(c)'))} AS l, {_sentences('c')} AS r FROM p), y AS (SELECT source, page_no, r, unnest(l) AS sentence, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS sentence_no FROM z) SELECT source AS file_path, page_no, sentence_no, CAST(len({_split('sentence')}) AS INTEGER) AS word_count, sentence, r[sentence_no] AS raw FROM y",
        "word_rows_raw": f"{_PAGES}, z AS (SELECT source, page_no, words AS r, {_split(_DIGITLESS.format('c'))} AS l FROM p), y AS (SELECT source, page_no, r, unnest(l) AS word, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS word_no FROM z) SELECT source AS file_path, page_no, word_no, CAST(length(word) AS INTEGER) AS word_length, word, r[word_no] AS raw FROM y",
        "tokenize_words": f"{_PAGES}, y AS (SELECT source, page_no, unnest(words) AS word, CAST(unnest(range(1, len(words) + 1)) AS INTEGER) AS word_no FROM p) SELECT source AS file_path, page_no, word_no, CAST(length(word) AS INTEGER) AS word_length, word FROM y",
        "file_stats": f"{_PAGES} SELECT source AS file_path, count(*) AS page_count, 0::BIGINT AS page_count_skipped, 0::BIGINT AS page_count_ocr, count(*) AS page_count_text, CAST(sum(len(words)) AS BIGINT) AS word_count FROM p GROUP BY source",
        "corpus_stats": f"{_PAGES} SELECT count(DISTINCT source) AS file_count, count(*) AS page_count, 0::BIGINT AS page_count_skipped, 0::BIGINT AS page_count_ocr, count(*) AS page_count_text, CAST(sum(len(words)) AS BIGINT) AS word_count, count(*) AS page_count_active FROM p",
        "freq_page": f"{_EACH} SELECT source AS file_path, page_no, word, count(*) AS freq FROM e WHERE word <> '' GROUP BY ALL",
        "freq_file": f"{_EACH} SELECT source AS file_path, word, count(*) AS freq FROM e WHERE word <> '' GROUP BY ALL",
        "freq_corpus": f"{_CORPUS} SELECT word, freq FROM n",
        "freq_corpus_last_wins": f"{_EACH} SELECT word, arg_max(freq, overall) AS freq FROM (SELECT word, overall, count(*) AS freq FROM e WHERE word <> '' GROUP BY ALL) GROUP BY word",
        "freq_sorted_alpha": f"{_CORPUS} SELECT row_number() OVER (ORDER BY word) AS rank, word, freq FROM n",
        "freq_sorted_freq": f"{_EACH} SELECT row_number() OVER (ORDER BY freq DESC, first) AS rank, word, freq FROM n",
        "freq_chron": f"{_EACH} SELECT row_number() OVER (ORDER BY first) AS rank, word, freq FROM n",
        "freq_limit_pct_70": _percent(70), "freq_limit_pct_7": _percent(7),
        "freq_limit_top_100": f"{_EACH} SELECT word, freq FROM n ORDER BY freq DESC, first LIMIT 100",
        "freq_file_limit_pct_70": _scoped("0 AS none", "70%"), "freq_file_limit_top_100": _scoped("0 AS none", "100"),
        "freq_page_limit_top_10": _scoped("page_no", "10"), "freq_page_limit_pct_28": _scoped("page_no", "28%"),
        "freq_limit_min_50": f"{_CORPUS} SELECT word, freq FROM n WHERE freq >= 50",
        "freq_only": f"{_CORPUS} SELECT word, freq FROM n WHERE word IN ({_quoted(LISTED)})",
        "freq_ignore": f"{_CORPUS} SELECT word, freq FROM n WHERE word NOT IN ({_quoted(LISTED)})",
        "freq_stopwords": f"{_CORPUS} SELECT word, freq FROM n WHERE word NOT IN ({_quoted(_stop_words())})",
        "freq_pos": f"{_DOC} SELECT {_bare('t')} AS word, {_tag_sql('t')} AS pos, count(*) AS freq FROM (SELECT unnest({_split('c')}) AS t FROM c9) WHERE {_bare('t')} <> '' GROUP BY ALL",
        "pos_lexicon": f"{_learned_sql()} SELECT word, pos FROM lex",
        "pos_tags": f"{_context_sql()} SELECT doc_id, i AS word_no, t AS token, g AS pos FROM k",
        "freq_pos_context": f"{_context_sql()} SELECT {_bare('t')} AS word, g AS pos, count(*) AS freq FROM k WHERE {_bare('t')} <> '' GROUP BY ALL",
        "process_punctuation": doc(_NO_PUNCT),
        "process_digits": doc("regexp_replace(c, '\\d', '', 'g')"),
        "process_numeric_words": doc(f"array_to_string([t FOR t IN {_split('c')} IF NOT regexp_matches(t, '\\d')], ' ')"),
        "process_lowercase": doc("lower(c)"),
        "process_only": doc(f"array_to_string(flatten([{only}]), ' ')"),
        "process_ignore": doc(_ignoring("c")),
        "process_chain": doc(chain),
        "process_stopwords": doc(_ignoring("c", _stop_words())),
        "process_only_stopwords": doc("array_to_string(flatten([" + ", ".join(f"regexp_extract_all(c, '(?i)\\b{_q(w)}\\b')" for w in _stop_words()) + "]), ' ')"),
        "autocorrect": _joined("benchmark", "item_id", "true"),
        "autocorrect_remove": _joined("benchmark", "item_id", "confidence > 0 OR kind = 'punctuation'"),
        "autocorrect_documents": _joined("documents", "doc_id", "true"),
        "autocorrect_remove_documents": _joined("documents", "doc_id", "confidence > 0 OR kind = 'punctuation'"),
        "remove_unknown": f"{_DOC}, tok AS (SELECT doc_id, unnest(words) AS token, unnest(range(0, len(words))) AS pos FROM (SELECT doc_id, {_marked('c')} AS words FROM c9)), d AS (SELECT word FROM ({_ALL}) WHERE freq > {FREQ_CUT}) SELECT d0.doc_id, {_glued('token', "lower(token) IN (SELECT word FROM d) OR NOT regexp_matches(token, '[A-Za-z0-9]')")} AS text FROM documents d0 LEFT JOIN tok ON d0.doc_id = tok.doc_id GROUP BY d0.doc_id",
        "corrections": _logged("benchmark", "item_id"),
        "corrections_documents": _logged("documents", "doc_id"),
        "spelling_suggest": _suggested("benchmark"),
        "spelling_suggest_documents": _suggested("documents"),
        "lemmatize": _lemma_sql(),
        "dict_train": _TRAIN.format("documents"),
        "dict_merge": _TRAIN.format("(SELECT text FROM documents UNION ALL SELECT text FROM conversations)"),
        "dict_shrink": f"SELECT * FROM ({_TRAIN.format('documents')}) WHERE freq > 5",
        "dict_cap": f"WITH n AS ({_TRAIN.format('documents')}), t AS (SELECT i FROM (SELECT DISTINCT freq AS i FROM n UNION SELECT 0) WHERE (SELECT count(*) FROM n WHERE freq > i) <= 5000) SELECT word, freq FROM n WHERE freq > (SELECT min(i) FROM t)",
        "dict_add": f"SELECT word, CAST(sum(freq) AS BIGINT) AS freq FROM ({_ALL} UNION ALL SELECT * FROM (VALUES ('a', 2), ('banana', 1), ('bandana', 1), ('the', 1)) v(word, freq)) GROUP BY word",
        "dict_remove": f"SELECT * FROM ({_ALL}) WHERE word NOT IN ('the', 'and', 'zzz')",
    }


def queries() -> dict[str, Query]:
    return dict(QUERIES)
