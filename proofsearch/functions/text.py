"""Text functions as column expressions, and their DuckDB spelling where a query is checked against SQL."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that carry no meaning of their own, French and English.
STOPWORDS = [
    "a", "au", "aux", "avec", "ce", "ces", "cet", "cette", "dans", "de", "des", "du", "elle", "en", "et", "est", "etre", "il", "ils", "je", "la", "le", "les", "leur", "lui",
    "ma", "mais", "me", "meme", "mes", "moi", "mon", "ne", "nos", "notre", "nous", "on", "ou", "par", "pas", "pour", "qu", "que", "quel", "quelle", "quels", "quelles",
    "qui", "sa", "se", "ses", "son", "sont", "sur", "ta", "te", "tes", "toi", "ton", "tu", "un", "une", "vos", "votre", "vous", "y", "d", "l", "s", "n", "c", "j", "m", "t",
    "comment", "combien", "quoi", "ou", "quand", "pourquoi", "sous", "peut", "peuvent", "lequel", "laquelle", "lesquels", "lesquelles",
    "faire", "fait", "dire", "avoir", "plus", "moins", "tres", "aussi", "entre", "ainsi", "alors", "donc", "cela", "ceci", "ca", "chaque", "quelque",
    "the", "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were", "what",
    "which", "who", "whom", "why", "how", "with", "this", "these", "those", "do", "does", "did", "can", "could", "should", "would", "will", "about",
    "into", "than", "then", "there", "their", "them", "they", "also", "more", "less", "very",
]
#: Suffixes in the order in which they are tried.
SUFFIXES = [
    "issements", "issement", "atrices", "ateurs", "ations", "ements", "ement", "atrice", "ateur",
    "ation", "ances", "ences", "ance", "ence", "euses", "euse", "ites", "ite", "ives", "ive",
    "ees", "ers", "ent", "ee", "er", "ez", "es", "e", "s", "x",
]
STEM_PATTERN = f"^([^0-9]{{4,}}?)(?:{'|'.join(SUFFIXES)})$"
WORD_PATTERN = "[a-z0-9]+(?:[.,][0-9]+)?"


def _folded() -> tuple[str, str]:
    """Accented lower-case Latin letters, and the letter that is left of each without its marks."""
    pairs = []
    for c in map(chr, range(0xC0, 0x250)):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != c and c == c.lower():
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _folded()


def normalize(text: Column) -> Column:
    """Lower case without accents, JVM-side: Latin letters; `strip_accents_any` covers all of Unicode."""
    return F.translate(F.lower(text), ACCENTED, BARE)


@F.pandas_udf(StringType())
def strip_accents_any(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def words(text: Column) -> Column:
    """Normalised words; decimal numbers stay whole."""
    return F.regexp_extract_all(normalize(text), F.lit(WORD_PATTERN), F.lit(0))


def stem(word: Column) -> Column:
    """A word with a digit as it is; else without the first listed suffix that leaves four letters."""
    return F.regexp_replace(word, STEM_PATTERN, "$1")


def is_content(word: Column) -> Column:
    return (F.length(word) > 1) & ~word.isin(STOPWORDS)


def content_words(text: Column) -> Column:
    """Stemmed words that carry meaning, in order and with repeats."""
    return F.transform(F.filter(words(text), is_content), stem)


def identifiers(text: Column) -> Column:
    """Distinct words with a digit."""
    return F.array_distinct(F.filter(words(text), lambda w: w.rlike("[0-9]")))


def estimate_tokens(text: Column) -> Column:
    """About four characters a token; nothing for nothing."""
    n = F.length(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4))).cast("long")


def split_sentences(text: Column) -> Column:
    """After `.!?;` and white space, or at line ends; decimals survive."""
    parts = F.transform(F.split(text, r"(?<=[.!?;])\s+|\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def chunk_text(text: Column, max_tokens: int = 120) -> Column:
    """Sentences packed in order into chunks of about `max_tokens`; a sentence is never cut."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        t = estimate_tokens(s)
        full = (acc["n"] > 0) & (acc["n"] + t > max_tokens)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["n"] == 0), s).otherwise(F.concat(acc["now"], F.lit(" "), s)).alias("now"),
            (F.when(full, 0).otherwise(acc["n"]) + t).alias("n"),
        )

    return F.aggregate(split_sentences(text), state, step, lambda a: F.when(a["n"] > 0, F.array_append(a["done"], a["now"])).otherwise(a["done"]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets in arrays; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def stems(text: Column) -> Column:
    """All words' stems between single spaces."""
    return F.concat(F.lit(" "), F.array_join(F.transform(words(text), stem), " "), F.lit(" "))


def stems_of(phrase: str) -> str:
    """The same of a phrase that is known beforehand."""
    plain = phrase.lower().translate(str.maketrans(ACCENTED, BARE))
    return f" {' '.join(re.sub(STEM_PATTERN, r'\1', w) for w in re.findall(WORD_PATTERN, plain))} "


def has_phrase(text: Column, phrase: Column) -> Column:
    """The phrase's words in a row, up to their endings; an empty phrase is nowhere."""
    return (F.size(words(phrase)) > 0) & F.contains(stems(text), stems(phrase))


def title_key(title: Column) -> Column:
    """Words of a title without one closing qualifier in parentheses; empty without a content word or under three characters."""
    w = words(F.regexp_replace(title, r"\s*\([^()]*\)\s*$", ""))
    meaning = F.exists(w, is_content)
    return F.when(meaning & (F.length(F.array_join(w, " ")) >= 3), w).otherwise(F.array().cast("array<string>"))


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(normalize(text), r"\s+", " "))


def quote_in_source(quote: Column, source: Column) -> Column:
    """Whether the quote stands in the source, white space and accents aside; an empty one does not."""
    return quote_in_flat(quote, flat(source))


def quote_in_flat(quote: Column, plain: Column) -> Column:
    """The same for a source that is flat already."""
    return (flat(quote) != "") & F.contains(plain, flat(quote))


def domain_of(url: Column) -> Column:
    """The host in lower case without a leading www., empty where there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no English article, single spaces."""
    bare = F.translate(F.lower(text), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(?:a|an|the)\b", " "), r"\s+", " "))


def facet_key(text: Column) -> Column:
    """Normalised, spaces as hyphens, 80 characters; `general` if empty."""
    k = F.substring(F.regexp_replace(F.trim(normalize(text)), r"\s+", "-"), 1, 80)
    return F.coalesce(F.nullif(k, F.lit("")), F.lit("general"))


def slug(text: Column) -> Column:
    """Snake case of 40 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(normalize(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 40)


def numbers(text: Column) -> Column:
    """Distinct numbers of a text; `1 299` is 1299 and a comma is a point."""
    joined = F.regexp_replace(text, "(?<=[0-9])[ \xa0\u202f](?=[0-9]{3}(?![0-9]))", "")
    return F.array_distinct(F.transform(F.regexp_extract_all(joined, F.lit("[0-9]+(?:[.,][0-9]+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("."))))


def numbers_supported(answer: Column, evidence: Column) -> Column:
    """Every number of the answer is in the evidence."""
    return F.size(F.array_except(numbers(answer), numbers(evidence))) == 0


def value_in_quote(value: Column, quote: Column) -> Column:
    """All words of the value (single letters aside) are words of the quote, and there is one."""
    own = F.filter(words(value), lambda w: (F.length(w) > 1) | w.rlike("^[0-9]$"))
    return (F.size(own) > 0) & (F.size(F.array_except(own, words(quote))) == 0)


#: Other names of attributes.
ATTRIBUTE_ALIASES = {
    "prix": "price",
    "cost": "price",
    "cout": "price",
    "tarif": "price",
    "memory": "ram",
    "memoire_vive": "ram",
    "memoire": "ram",
    "stockage": "storage",
    "disk": "storage",
    "ssd": "storage",
    "processor_cores": "cores",
    "coeurs": "cores",
    "cpu_cores": "cores",
    "poids": "weight",
    "ecran": "screen",
    "screen_size": "screen",
    "frequence": "frequency",
    "puissance": "power",
    "gpu_memory": "vram",
    "memoire_graphique": "vram",
}


def attribute_name(raw: Column) -> Column:
    """The slug of a name, or what it is another name of; `statement` if nothing is left."""
    own = F.coalesce(F.nullif(slug(raw), F.lit("")), F.lit("statement"))
    names = F.create_map(*[F.lit(x) for kv in ATTRIBUTE_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, own), own)


def content_id(*parts: Column, length: int = 16) -> Column:
    """A short digest of texts, the same on every engine."""
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, length)


def rounded(x: Column, places: int) -> Column:
    """Halves to the even digit, as the shortest decimal of the double says; not a number is 0."""
    return F.bround(F.nanvl(x, F.lit(0.0)), places)


def json_block(text: Column) -> Column:
    """From the first opening brace to the last closing one; null without."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def char_features(word: Column) -> Column:
    """Trigrams of a word between spaces."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substr(padded, i, F.lit(3)))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(x, F.lit(0.0))))


def settled(x: Column, places: int = 6) -> Column:
    """Rounded so that ties, which sums and products in any order only nearly hit, go up on every engine."""
    return F.round(x + 1e-9, places)


class sql:  # noqa: N801  a namespace
    """The same in DuckDB."""

    stop = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"

    @staticmethod
    def normalize(c: str) -> str:
        return f"translate(lower({c}), '{ACCENTED}', '{BARE}')"

    @classmethod
    def words(cls, c: str) -> str:
        return f"regexp_extract_all({cls.normalize(c)}, '{WORD_PATTERN}')"

    @staticmethod
    def stem(w: str) -> str:
        return f"regexp_replace({w}, '{STEM_PATTERN}', '\\1')"

    @classmethod
    def content_words(cls, c: str) -> str:
        return f"list_transform(list_filter({cls.words(c)}, lambda w: length(w) > 1 AND NOT list_contains({cls.stop}, w)), lambda w: {cls.stem('w')})"

    @staticmethod
    def sentences(c: str) -> str:
        marked = f"regexp_replace(regexp_replace({c}, '([.!?;])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g')"
        return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')"

    @staticmethod
    def tokens(c: str) -> str:
        return f"(CASE WHEN length({c}) = 0 THEN 0 ELSE greatest(1, ceil(length({c}) / 4.0)) END)::BIGINT"
