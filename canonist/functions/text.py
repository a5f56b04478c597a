"""Column functions on text, dates and ids. Built-in expressions only, but for normal form C, canonical JSON and answers' JSON."""

from __future__ import annotations

import json
import re
import unicodedata
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quote marks and hyphens that are folded, characters that are dropped, white space, line breaks.
QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "‹": "'", "›": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "«": '"', "»": '"'}
HYPHENS = "‐‑"
DROPPED = "­​‌‍⁠﻿"
WHITE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE = rf"[{WHITE}]+"
BREAK = r"\r\n|\r|\n|\x{2028}|\x{2029}"
#: Tokens in which a change is never forgiven, besides those with a digit. `may` counts only beside a number.
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend"
).split()
MONTH_WORDS = "january february march april june july august september october november december januar februar märz mai juni juli oktober dezember".split()
NEGATIONS = "not no nicht kein keine keinen keinem keiner keines".split()
HARD = tuple(NUMBER_WORDS + MONTH_WORDS + NEGATIONS)
EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
#: A list label in front of a quotation, and the marks of an ellipsis.
LABEL = r"(?i)^(?:\(\s*\d{1,3}[a-z]{0,2}\s*\)|\(\s*[a-z]{1,4}\s*\)|\d{1,3}[a-z]{0,2}[.)]|[a-z][.)]|[—–•·-])\s+"
ELLIPSIS = r"\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|…|\.{3}"
#: Function words that tell the language of a text.
FUNCTION_WORDS = {
    "en": "the of and to shall be that is are with for which by as this or it not any from such their its has have where whether those other under must may will on at if been when than there these into".split(),
    "de": "der die das und den dem des ein eine einer einem eines nicht ist sind werden wird von mit für auf im zu zur zum dass oder auch nach bei als sich wenn kann können müssen gemäß sowie diese dieser diesem dieses durch aus über unter wurden hat haben soll sollen sein ihre ihrer ihren dies".split(),
}
#: Fixed values of search: words left out, and what tells the language of a query.
STOPWORDS = (
    "a an and are as at be been but by for from has have in into is it its of on or such that the their then there these this those to was were which will with shall "
    "aber als am auch auf aus bei bis das dass dem den der des die ein eine einer eines einem einen er es für hat im ist mit nach nicht oder sich sie sind so über und von vom war wird zu zum zur"
).split()
QUERY_WORDS = {
    "en": "a an and are as at be been but by for from has have in into is it its of on or such that the their then there these this those to was were which will with shall what how when who must does do can".split(),
    "de": "aber als am auch auf aus bei bis dass dem den der des die ein eine einer eines einem einen er es für hat im ist mit nach nicht oder sich sie sind so über und von vom war wird zu zum zur welche welcher wann wie muss müssen gilt gelten".split(),
}
QUERY_PARTS = "pflicht betreiber anbieter hochrisiko verbot frist kennzeichnung gesetz verordnung bewertung aufsicht behörde zulassung konformität nachweis einführer händler bevollmächtigt".split()
QUERY_ENDINGS = "(?:ung|ungen|keit|keiten|heit|heiten|schaft|schaften|lich|liche|lichen|licher|isch|ische|ischen)$"
#: Names of months, in the order of the year; further ones and short ones by number.
MONTHS = "january february march april may june july august september october november december".split()
MONTHS_DE = "januar februar märz april mai juni juli august september oktober november dezember".split()
MONTHS_SHORT = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12, "maerz": 3, "okt": 10, "dez": 12}
MONTH_NUMBER = {name: i for names in (MONTHS, MONTHS_DE) for i, name in enumerate(names, 1)} | MONTHS_SHORT
#: What names the newer and the older version.
NEWER_HINTS = ["2026/1744", "20260727", "consolidated", "konsolidiert", "omnibus"]
OLDER_HINTS = ["32024r1689", "2024/1689", "official journal", "amtsblatt"]
NEWER_IDS = ["20260727", "2026/1744", "32026r1744"]
NEWER, OLDER = "02024R1689-20260727", "32024R1689"


def nfc(s: Column) -> Column:
    """Normal form C; only texts beyond ASCII leave the JVM."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return F.when(s.rlike(r"[^\x00-\x7F]"), F.pandas_udf(run, "string")(s)).otherwise(s)


def normalize(s: Column, compose: bool = True) -> Column:
    """Composed, without invisible characters; quotes and hyphens folded, single spaces, no empty lines."""
    s = nfc(s) if compose else s
    s = F.translate(s, "".join(QUOTES) + HYPHENS + DROPPED, "".join(QUOTES.values()) + "-" * len(HYPHENS))
    lines = F.transform(F.split(s, BREAK), lambda x: F.trim(F.regexp_replace(x, SPACE, " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def node_hash(heading: Column, text: Column, compose: bool = True) -> Column:
    """Hash of normalised heading, line feed, normalised text; null counts as empty."""
    return F.sha2(F.concat(normalize(F.coalesce(heading, F.lit("")), compose), F.lit("\n"), normalize(F.coalesce(text, F.lit("")), compose)), 256)


MARK = "\uffff"


def matches(s: Column, pattern: str) -> Column:
    """start, end (code points, end exclusive) and text of every match of a pattern, in order. The pattern matches no empty text.
    What stands between the matches tells where they are, so no regex engine but the JVM's is needed. The matches are replaced by
    one mark and the text is split there, since a split by the pattern itself would compile it anew for every text. Should the text
    hold the mark, which is no character, it reads as U+FFFD."""
    s = F.translate(s, MARK, "\ufffd")
    found, between = F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), F.split(F.regexp_replace(s, pattern, MARK), MARK, -1)
    # one more stands between than is found: the last pair has no match
    pairs = F.zip_with(between, found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"), hit.alias("hit")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)")

    def step(acc: Column, x: Column) -> Column:
        hit = F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("end"), x["hit"].alias("text"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(hit["end"].alias("at"), F.concat(acc["out"], F.array(hit)).alias("out")))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]


def token_spans(s: Column) -> Column:
    """norm, shown, start, end of every token: white space around, punctuation at the edges off, empty ones dropped. start and end
    are those of the whole run of other characters."""
    told = F.transform(matches(s, f"[^{WHITE}]+"), lambda m: F.struct(F.regexp_replace(m["text"], EDGE, "").alias("shown"), m["start"].alias("start"), m["end"].alias("end")))
    return F.transform(F.filter(told, lambda x: x["shown"] != ""), lambda x: F.struct(F.lower(x["shown"]).alias("norm"), x["shown"].alias("shown"), x["start"].alias("start"), x["end"].alias("end")))


def shown_tokens(s: Column) -> Column:
    """Tokens as written."""
    return F.filter(F.transform(F.split(s, SPACE), lambda x: F.regexp_replace(x, EDGE, "")), lambda x: x != "")


def tokens(s: Column) -> Column:
    """Lower-case tokens between white space, without what is no letter or digit at their edges; empty ones dropped."""
    return F.transform(shown_tokens(s), lambda x: F.lower(x))


def hard_flags(toks: Column, words: tuple[str, ...] = HARD) -> Column:
    """For each token whether a change in it is never forgiven. `may` is a month only beside a number of up to four digits."""
    number = lambda i: F.coalesce(F.get(toks, i).rlike(r"^\d{1,4}$"), F.lit(False))
    return F.transform(toks, lambda t, i: t.rlike(r"\d") | t.isin(*words) | ((t == "may") & (number(i - 1) | number(i + 1))))


def flat_quote(s: Column, compose: bool = True) -> Column:
    """A quotation normalised, in one line, without list labels in front (two at most)."""
    s = F.translate(normalize(s, compose), "\n", " ")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(s, LABEL, "")), LABEL, ""))


def prepare_quote(s: Column, compose: bool = True) -> Column:
    """The segments of a quotation between its ellipses: text, shown (tokens as written), toks; those without tokens are dropped."""
    parts = F.transform(F.split(flat_quote(s, compose), ELLIPSIS), lambda x: F.trim(x))
    told = F.transform(parts, lambda x: F.struct(x.alias("text"), shown_tokens(x).alias("shown"), tokens(x).alias("toks")))
    return F.filter(told, lambda x: F.size(x["toks"]) > 0)


def comparable(s: Column) -> Column:
    """Single spaces, nothing at the edges that is no letter or digit."""
    return F.regexp_replace(F.regexp_replace(s, SPACE, " "), EDGE, "")


def words(s: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def stem(w: Column, lang: str = "en") -> Column:
    """Light suffix stripping, alike for documents and queries of a language."""
    cut = lambda n: F.left(w, F.length(w) - n)
    if lang == "de":
        noun = F.regexp_extract(w, "^(.{3,}(?:ung|ion|heit|keit|schaft|tät))(?:en)?$", 1)
        return F.when(noun != "", noun).when(w.rlike("^.{4,}en$"), cut(2)).when(w.rlike("^.{4,}[ens]$"), cut(1)).otherwise(w)
    plural = F.when(w.rlike("^.{3,}ies$"), F.concat(cut(3), F.lit("y"))).when((F.length(w) > 5) & w.rlike("(?:ss|x|ch|sh)es$"), cut(2))
    plural = plural.when((F.length(w) > 4) & w.rlike("(?<!s|u|i)s$"), cut(1))
    return plural.when(w.rlike("^.{4,}ing$"), cut(3)).when(w.rlike("^.{4,}ed$"), cut(2)).otherwise(w)


def stems(s: Column, lang: str = "en", stopwords: list[str] = ()) -> Column:
    """Stems of the words of a text, in order, without these words."""
    kept = F.filter(words(s), lambda w: ~w.isin(*stopwords)) if stopwords else words(s)
    return F.transform(kept, lambda w: stem(w, lang))


def detect_lang(toks: Column, marks: dict[str, list[str]] = FUNCTION_WORDS, ratio: int = 2) -> Column:
    """The language whose function words occur at least `ratio` times as often as any other's; null if undecided."""
    among = lambda v: F.size(F.filter(toks, lambda t: t.isin(*v)))
    count = {k: among(v) for k, v in marks.items()}
    out = F.lit(None).cast("string")
    for k, n in reversed(count.items()):
        others = F.greatest(*[x for j, x in count.items() if j != k], F.lit(0)) if len(count) > 1 else F.lit(0)
        out = F.when((n > 0) & (n >= ratio * others), k).otherwise(out)
    return out


def query_lang(query: Column) -> Column:
    """Language of a query: de where umlauts, German words, parts of words and endings outweigh English words, else en."""
    en, de = (set(QUERY_WORDS[k]) for k in ("en", "de"))
    yes = lambda c, n=1: F.when(c, n).otherwise(0)

    def weight(w: Column) -> Column:
        part = reduce(lambda a, p: a | F.contains(w, F.lit(p)), QUERY_PARTS, F.lit(False)) | w.rlike(QUERY_ENDINGS)
        return yes(w.rlike("[äöüß]"), 2) + yes(w.isin(*sorted(de - en))) - yes(w.isin(*sorted(en - de))) + yes((F.length(w) >= 6) & part)

    return F.when(F.aggregate(words(query), F.lit(0), lambda a, w: a + weight(w)) > 0, "de").otherwise("en")


def with_snippets(df: DataFrame, source: str, terms: str, lang: str = "en", out: str = "snippet", most: int = 240, lead: int = 80) -> DataFrame:
    """df with at most `most` characters of a text around the first word of terms (words or stems), cut between words, with an ellipsis
    where cut."""
    df = df.withColumn("__text", F.trim(F.regexp_replace(source, SPACE, " ")))
    long = F.when(F.length("__text") > most, F.col("__text"))
    df = df.withColumn("__hits", F.transform(matches(long, r"[\p{L}\p{N}]+"), lambda m: F.struct(m["start"].alias("start"), F.lower(m["text"]).alias("w"))))
    df = df.withColumn("__at", F.coalesce(F.get(F.filter("__hits", lambda m: F.array_contains(terms, m["w"]) | F.array_contains(terms, stem(m["w"], lang))), F.lit(0))["start"], F.lit(0)))
    df = df.withColumn("__back", F.greatest(F.lit(0), F.col("__at") - lead)).withColumn("__gap", F.locate(" ", F.substring("__text", F.col("__back") + 1, F.length("__text"))))
    # from after the next blank on, if that does not pass the word
    forward = (F.col("__back") > 0) & (F.col("__gap") > 0) & (F.col("__back") + F.col("__gap") - 1 <= F.col("__at"))
    df = df.withColumn("__from", F.when(forward, F.col("__back") + F.col("__gap")).otherwise(F.col("__back")))
    df = df.withColumn("__room", F.least(F.length("__text"), F.col("__from") + most - F.when(F.col("__from") > 0, 1).otherwise(0) - 1))
    # up to the last blank, if that is behind the word
    df = df.withColumn("__last", F.col("__room") + 1 - F.locate(" ", F.reverse(F.substring("__text", F.lit(1), F.col("__room") + 1))))
    df = df.withColumn("__to", F.when((F.col("__room") < F.length("__text")) & (F.col("__last") <= F.col("__room")) & (F.col("__last") > F.col("__at")), F.col("__last")).otherwise(F.col("__room")))
    made = F.concat(F.when(F.col("__from") > 0, "…").otherwise(""), F.trim(F.substring("__text", F.col("__from") + 1, F.col("__to") - F.col("__from"))), F.when(F.col("__to") < F.length("__text"), "…").otherwise(""))
    df = df.withColumn("__made", made)
    cut = F.when(F.length("__made") > most, F.concat(F.left("__made", F.lit(most - 1)), F.lit("…"))).otherwise(F.col("__made"))
    return df.withColumn(out, F.when(F.length("__text") <= most, F.col("__text")).otherwise(cut)).drop("__text", "__hits", "__at", "__back", "__gap", "__from", "__room", "__last", "__to", "__made")


def is_iso_date(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def made_date(y: Column, m: Column, d: Column) -> Column:
    """ISO date of three numbers as text; null where there is no such day."""
    text = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.date_format(F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text), F.lit("yyyy-MM-dd")), "yyyy-MM-dd")


def month_number(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for m, i in MONTH_NUMBER.items() for x in (m, str(i))]), name)


def parse_date(s: Column) -> Column:
    """The first date written in a text as ISO: y-m-d, d.m.yyyy, day month year, month day year, in English or German; null where
    there is none or no such day."""
    low = F.regexp_replace(F.lower(F.trim(s)), r"(\d)(?:st|nd|rd|th)\b", "$1")
    of = lambda p, i: F.nullif(F.regexp_extract(low, p, i), F.lit(""))
    ymd, dots = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", r"(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})"
    dmy, mdy = r"(\d{1,2})\.?\s+(?:of\s+)?([a-zäöü]+)\.?,?\s+(\d{4})", r"([a-zäöü]+)\.?\s+(\d{1,2}),?\s+(\d{4})"
    made = [(ymd, made_date(of(ymd, 1), of(ymd, 2), of(ymd, 3))), (dots, made_date(of(dots, 3), of(dots, 2), of(dots, 1)))]
    made += [(dmy, made_date(of(dmy, 3), month_number(of(dmy, 2)), of(dmy, 1))), (mdy, made_date(of(mdy, 3), month_number(of(mdy, 1)), of(mdy, 2)))]
    out = F.lit(None).cast("string")
    for pattern, value in reversed(made):
        out = F.when(low.rlike(pattern), value).otherwise(out)
    return out


def readable_date(iso: Column, lang: Column) -> Column:
    """2 August 2027, or 2. August 2027 in German; what is no ISO date stays."""
    m, d, y = (F.regexp_extract(iso, r"^(\d{4})-(\d{2})-(\d{2})$", i) for i in (2, 3, 1))
    at = lambda names: F.try_element_at(F.array(*[F.lit(n.capitalize()) for n in names]), F.coalesce(m.try_cast("int"), F.lit(99)))
    name = F.when(lang == "de", at(MONTHS_DE)).otherwise(at(MONTHS))
    return F.when(name.isNull(), iso).otherwise(F.concat(d.try_cast("int").cast("string"), F.when(lang == "de", ". ").otherwise(" "), name, F.lit(" "), y))


def named_version(s: Column) -> Column:
    """The version that a text hints at: the newer one's hints first; null without any."""
    return F.when(_any(s, NEWER_HINTS), NEWER).when(_any(s, OLDER_HINTS), OLDER)


def version_named(s: Column) -> Column:
    """The version that a text names by its identifiers; both, where neither is said to be meant; null without any."""
    new, old = _any(s, NEWER_IDS), _any(s, OLDER_HINTS)
    return F.when(new & _any(s, [NEWER.lower(), "amended", "geändert"]), NEWER).when(new & old, "both").when(new, NEWER).when(old, OLDER)


def _any(s: Column, parts: list[str]) -> Column:
    low = F.lower(s)
    return reduce(lambda a, p: a | F.contains(low, F.lit(p)), parts, F.lit(False))


def claim_holds(claim: Column, answer: Column) -> Column:
    """A claim of one word, yes or no (ja, nein), is held against the answer's first word; any other is contained, case aside."""
    first = lambda s: F.nullif(F.regexp_extract(F.lower(s), r"^[^\p{L}]*([\p{L}]+)", 1), F.lit(""))
    fold = lambda w: F.when(w == "ja", "yes").when(w == "nein", "no").otherwise(w)
    wanted = fold(first(claim))
    bare = claim.rlike(r"^[^\p{L}]*[\p{L}]+[^\p{L}]*$") & wanted.isin("yes", "no")
    return F.coalesce(F.when(bare, fold(first(answer)) == wanted).otherwise(F.contains(F.lower(answer), F.lower(F.trim(claim)))), F.lit(False))


def es_number(x: float) -> str:
    """A double as ECMAScript writes it: shortest digits, exponents from 1e21 on and below 1e-6."""
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == 0:
        return "0"
    _, digits, exponent = Decimal(repr(abs(x))).as_tuple()
    s = "".join(map(str, digits)).lstrip("0")
    point, s = len(s) + exponent, s.rstrip("0")
    if point > 21 or point <= -6:
        power = f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
        told = s[0] + ("." + s[1:] if len(s) > 1 else "") + power
    elif point <= 0:
        told = "0." + "0" * -point + s
    else:
        told = s.ljust(point, "0") if len(s) <= point else f"{s[:point]}.{s[point:]}"
    return "-" * (x < 0) + told


def _refused(name: str):
    raise ValueError(name)


def _decoder() -> json.JSONDecoder:
    """Numbers are doubles, whatever they look like; NaN and its like are no JSON."""
    return json.JSONDecoder(parse_int=float, parse_float=float, parse_constant=_refused)


def _canonical(x) -> str:
    if isinstance(x, dict):
        told = sorted(x.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_canonical(k)}:{_canonical(v)}" for k, v in told) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_canonical, x)) + "]"
    if isinstance(x, float):
        return es_number(x)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(x, ensure_ascii=False))


def canonical_json(s: Column) -> Column:
    """A JSON text with keys sorted by UTF-16 units, without white space, letters as they are, numbers as ECMAScript writes them; null where it
    is no JSON."""

    def one(t: str) -> str | None:
        try:
            return _canonical(_decoder().decode(t))
        except ValueError:
            return None

    return F.pandas_udf(lambda texts: texts.map(one, na_action="ignore"), "string")(s)


ANSWER = ("date", "version", "article", "quote", "answer", "verdict")


def parse_answer(s: Column) -> Column:
    """The fields of the first JSON object in a model's text (in a fence, if one holds any), as strings; null without an object."""
    told = ", ".join(f"{f} string" for f in ANSWER)

    def one(t: str | None) -> str | None:
        at = -1 if t is None else t.find("{")
        if at < 0:
            return None
        try:
            value, _ = _decoder().raw_decode(t, at)
        except ValueError:
            return None
        text = lambda v: v if isinstance(v, str) else _canonical(v)
        return json.dumps({f: text(value[f]) for f in ANSWER if isinstance(value.get(f), str | int | float | bool)})

    fence = F.regexp_extract(s, r"(?is)```(?:json)?[ \t]*\r?\n?(.*?)```", 1)
    source = F.when(F.contains(fence, F.lit("{")), fence).otherwise(s)
    cut = F.pandas_udf(lambda texts: texts.map(one, na_action="ignore"), "string")(F.when(F.contains(source, F.lit("{")), source))
    return F.from_json(cut, told)
