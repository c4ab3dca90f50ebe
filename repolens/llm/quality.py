"""Quality rules: one threshold table compiled into one projection of length, symbol, stop-word and line ratios.

Every feature is a Spark expression over the row's own text: no user functions, no exchange, so the cost is that of the scan and a very long
text stays in its own row. Rules on stop words and on the length of words hold only where there is a list: not for texts with mostly letters of other scripts, nor for rows
that a column of language codes, if one is named, puts into a language without a list (``pt-BR`` counts as ``pt``; null says nothing).
Nulls: a null text has no words and is rejected. Rows that repeat are judged one by one. Columns besides the text
pass through unless a feature has their name, in which case the feature replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import SPACE_CHARS, let, words

# Frequent function words by language, lower case.
STOP_WORDS_OF = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "on", "as", "are", "be", "by", "at", "this", "have", "from", "or", "an", "a", "not"],
    "de": ["der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es"],
    "fr": ["le", "la", "les", "de", "du", "et", "en", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "au", "est", "pas", "avec", "il", "ne"],
    "es": ["el", "los", "las", "del", "y", "por", "con", "no", "se", "una", "su", "para", "al", "lo", "como"],
    "it": ["il", "di", "che", "e", "non", "per", "della", "sono", "gli", "nel", "alla", "più"],
    "pt": ["o", "os", "as", "um", "uma", "do", "da", "em", "com", "não", "mais", "dos"],
    "nl": ["het", "een", "van", "dat", "niet", "zijn", "voor", "met", "op", "te", "aan", "ook"],
    "pl": ["i", "w", "na", "z", "nie", "się", "do", "jest", "że", "o", "jak", "przez"],
    "cs": ["a", "v", "na", "je", "se", "že", "s", "z", "to", "pro", "ale", "jako"],
    "sv": ["och", "att", "det", "som", "en", "är", "av", "för", "med", "till", "inte", "den"],
    "da": ["og", "at", "det", "er", "en", "til", "af", "som", "for", "ikke", "der", "med"],
    "fi": ["ja", "on", "ei", "että", "se", "oli", "myös", "ovat", "kun", "mutta", "kuin", "tai"],
    "hu": ["a", "az", "és", "hogy", "nem", "egy", "is", "van", "meg", "volt", "de", "csak"],
    "ro": ["și", "de", "în", "la", "cu", "nu", "care", "este", "pe", "din", "pentru", "mai"],
    "tr": ["ve", "bir", "bu", "da", "de", "için", "ile", "olarak", "çok", "gibi", "daha", "ne"],
    "id": ["yang", "dan", "di", "dari", "untuk", "ini", "dengan", "itu", "pada", "tidak", "dalam", "adalah"],
    "ru": ["и", "в", "не", "на", "что", "с", "по", "как", "это", "а", "к", "из"],
    "uk": ["і", "в", "не", "на", "що", "з", "та", "до", "це", "як", "за", "у"],
    "el": ["και", "το", "να", "η", "ο", "της", "του", "με", "για", "από", "σε", "που"],
}
STOP_WORDS = sorted({w for of in STOP_WORDS_OF.values() for w in of})
#: All but letters, and the letters of these languages' scripts.
_NOT_FOREIGN = r"[^\p{L}]|[A-Za-z\x{C0}-\x{24F}\x{370}-\x{3FF}\x{400}-\x{4FF}]"
WINDOW = 5
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Threshold:
    """A text passes if ``low <= numerator + slack`` and ``numerator <= high`` in units of ``denominator``; a bound of None is open.

    ``slack`` is what short texts may lack: with 1 and a low of 0.05, twenty words need no hit. ``unless`` names a count of 0 or 1 that lifts the rule.
    """

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None
    slack: float = 0.0
    unless: str | None = None


#: Ratios are compared after cross-multiplication, so that no division rounds.
THRESHOLDS = [
    Threshold("mean_word_length", "word_chars", "n_words", 2, 14, unless="unlisted"),
    Threshold("symbols_to_words", "n_symbols", "n_words", None, 0.25),
    Threshold("stop_words_to_words", "n_stop_words", "n_words", 0.05, None, 1.0, "unlisted"),
    Threshold("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
    Threshold("words_like_the_one_before", "n_stutters", "n_words", None, 0.3),
    Threshold("longest_word", "longest_word", "one", None, 1000),
]


def _repeats(hashes: Column) -> Column:
    """Positions covered by windows of five hashes that occur twice or more."""
    at = lambda i: F.get(hashes, i)
    grams = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[at(i + k) for k in range(WINDOW)]))

    def covered(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
        hit = let(pairs, lambda s: F.filter(s, lambda x, j: same(s, x, j)))
        places = F.array_sort(F.transform(hit, lambda x: x["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    # most texts repeat nothing: for those a set of the windows is enough
    counted = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(F.size(hashes) < WINDOW, F.lit(0)).otherwise(counted)


def features(text: Column, lang: Column | None = None) -> Column:
    """A struct of the counts that rules refer to; all are long."""
    full = F.coalesce(text, F.lit(""))
    spoken = F.lower(F.substring_index(F.substring_index(F.lit(None).cast("string") if lang is None else lang, "-", 1), "_", 1))
    other = F.coalesce(~spoken.isin(*STOP_WORDS_OF), F.lit(False))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            let(F.transform(w, lambda x: F.xxhash64(x)), _repeats).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)).cast("long").alias("longest_word"),
            F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))).cast("long").alias("n_stutters"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    worded = F.filter(F.split(full, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    return F.struct(
        let(words(text), of_words).alias("w"),
        let(worded, of_lines).alias("l"),
        F.length(F.regexp_replace(full, r"[ \t-\r]+", "")).cast("long").alias("word_chars"),
        (F.length(F.regexp_replace(full, r"[^#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        other.alias("other"),
        # letters of other scripts, which only texts with code points beyond Latin, Greek and Cyrillic have
        F.when(F.regexp_like(full, F.lit(r"[\x{530}-\x{10FFFF}]")), F.length(F.regexp_replace(full, _NOT_FOREIGN, ""))).otherwise(0).cast("long").alias("n_foreign"),
    )


FEATURES = {
    "n_words": "w.n_words", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "w.n_repeat_words",
    "n_lines": "l.n_lines", "n_stop_words": "w.n_stop_words", "longest_word": "w.longest_word", "n_stutters": "w.n_stutters",
    "n_foreign": "n_foreign",
}


def compiled(rules: list[Threshold]) -> Column:
    """The threshold table as one boolean expression over the feature columns."""
    verdict = F.lit(True)
    for rule in rules:
        top = F.col(rule.numerator).cast("double")
        unit = F.lit(1.0) if rule.denominator == "one" else F.col(rule.denominator).cast("double")
        lifted = F.col(rule.unless) > 0 if rule.unless else F.lit(False)
        if rule.low is not None:
            verdict = verdict & (lifted | (top + F.lit(rule.slack) >= F.lit(float(rule.low)) * unit))
        if rule.high is not None:
            verdict = verdict & (lifted | (top <= F.lit(float(rule.high)) * unit))
    return verdict


def judge(docs: DataFrame, text: str = "text", rules: list[Threshold] | None = None, lang: str | None = None) -> DataFrame:
    """``docs`` with the features, ``base_failed`` and ``kept``. ``lang`` names a column of language codes."""
    spare = "_features"
    keep = [c for c in docs.columns if c not in (*FEATURES, "unlisted", "base_failed", "kept", spare)]
    spoken = None if lang is None else F.col(f"`{lang}`").cast("string")
    measured = docs.select(*[F.col(f"`{c}`") for c in keep], features(F.col(f"`{text}`"), spoken).alias(spare))
    unlisted = (F.col(f"{spare}.other") | (2 * F.col(f"{spare}.n_foreign") > F.col(f"{spare}.word_chars"))).cast("long").alias("unlisted")
    flat = measured.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"{spare}.{path}").alias(name) for name, path in FEATURES.items()], unlisted)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return flat.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(THRESHOLDS if rules is None else rules))


def kept_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns they came with. A column ``lang`` is read as language codes."""
    lang = F.col("`lang`").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"), lang.alias("_lang"))
    return judge(inner, "_text", lang="_lang").where("kept").select("_row.*")


_SQL_LANGUAGES = ", ".join(f"'{code}'" for code in STOP_WORDS_OF)
_SQL_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_SQL_RULES = " AND ".join(
    f"({f'{r.unless} > 0 OR ' if r.unless else ''}{r.numerator}::DOUBLE{f' + {r.slack}' if op == '>=' else ''} {op} {float(bound)} * {'1.0' if r.denominator == 'one' else r.denominator + '::DOUBLE'})"
    for r in THRESHOLDS
    for op, bound in ((">=", r.low), ("<=", r.high))
    if bound is not None
)
SQL = rf"""
WITH a AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, row_number() OVER () AS r
  FROM documents),
g AS (SELECT r, i, list_slice(w, i, i + 4) AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM a WHERE len(w) >= 5)),
many AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM many, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
    len(list_filter(w, lambda x: list_contains([{_SQL_STOP}], lower(x))))::BIGINT AS n_stop_words,
    coalesce(list_max(list_transform(w, lambda x: length(x))), 0)::BIGINT AS longest_word,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutters,
    (coalesce(lower(string_split(string_split(lang, '-')[1], '_')[1]) NOT IN ({_SQL_LANGUAGES}), false)
      OR 2 * length(regexp_replace(t, '{_NOT_FOREIGN}', '', 'g')) > length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')))::BIGINT AS unlisted
  FROM a LEFT JOIN cover USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ({_SQL_RULES}) AS kept FROM b"""
