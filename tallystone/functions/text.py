"""Text and JSON scalars as column expressions."""

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def squeezed(text: Column) -> Column:
    """Runs of white space (Unicode) as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def plain_word(word: Column) -> Column:
    """Lower case, a-z and digits only."""
    return F.regexp_replace(F.lower(word), "[^a-z0-9]", "")


def safe_name(name: Column) -> Column:
    """What is no word character, dot or hyphen becomes an underscore."""
    return F.regexp_replace(name, r"(?U)[^\w.\-]", "_")


def substituted(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered regular-expression substitutions (Java syntax)."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def units(text: Column, characters: bool = False) -> Column:
    """Characters, or words, of a text."""
    if characters:
        return F.filter(F.split(text, ""), lambda c: c != "")
    body = squeezed(text)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, " "))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def document_of(file_name: Column, language: str | None = None) -> Column:
    """A file name without .jsonl and then, if given, without the language's suffix."""
    stem = F.regexp_replace(file_name, r"\.jsonl$", "")
    return F.regexp_replace(stem, rf"\.{language}$", "") if language else stem


def numbered(prefix: Column, number: Column, width: int = 4) -> Column:
    return F.concat_ws("_", prefix, F.lpad(number.cast("string"), width, "0"))


def remapped(value: Column, mapping: dict[str, str]) -> Column:
    """A value by a vocabulary; what isn't in it stays."""
    if not mapping:
        return value
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return F.coalesce(F.try_element_at(table, value), value)


def escaped_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


# Fixed value: how explanations begin that tell their class.
ERROR_CLASS = r"^([a-z][a-z /-]{2,40}?):\s"


def error_class(explanation: Column) -> Column:
    """The class that an explanation begins with ("wrong name: ..."); null if none."""
    return F.nullif(F.regexp_extract(explanation, ERROR_CLASS, 1), F.lit(""))


def json_answer(answer: Column, schema: str) -> Column:
    """What lies between the first { and the last } of a model's answer, parsed; null if it isn't such JSON."""
    body = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    return F.when(body != "", F.from_json(body, schema, {"mode": "PERMISSIVE"}))


def without_thoughts(answer: Column) -> Column:
    return F.trim(F.regexp_replace(answer, r"(?s)<think>.*?</think>", ""))


def last_word_of(answer: Column, words: list[str]) -> Column:
    """The last of the given words in an answer, in lower case; null if none."""
    found = F.regexp_extract_all(F.lower(answer), F.lit(rf"\b({'|'.join(words)})\b"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def verdict(answer: Column) -> Column:
    """pass, fail or error: a bare word, else the last valid JSON verdict, else the last such word."""
    body = without_thoughts(answer)
    bare = F.regexp_replace(F.lower(body), r"[^a-z]", "")
    objects = F.regexp_extract_all(body, F.lit(r"(\{[^{}]*\})"), F.lit(1))
    read = F.transform(objects, lambda o: F.lower(F.get_json_object(o, "$.verdict")))
    valid = F.filter(read, lambda v: v.isin("pass", "fail"))
    return F.coalesce(F.when(bare.isin("pass", "fail"), bare), F.try_element_at(valid, F.lit(-1)), last_word_of(body, ["pass", "fail"]), F.lit("error"))


def yes_no(answer: Column) -> Column:
    """True, false or null: a JSON answer, else the last yes or no."""
    body = without_thoughts(answer)
    said = F.coalesce(F.lower(F.get_json_object(F.regexp_extract(body, r"(?s)\{.*\}", 0), "$.answer")), last_word_of(body, ["yes", "no"]))
    return F.when(said == "yes", True).when(said == "no", False)


def number(value: Column) -> Column:
    """A number or numeric string as double; booleans and all else null. ``value`` is JSON text."""
    bare = F.trim(F.regexp_replace(value, '^"|"$', ""))
    return F.when(~F.lower(F.trim(value)).isin("true", "false"), bare.try_cast("double"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common from their start."""
    short = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), short), F.slice(b, F.lit(1), short), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)
    return F.when(at == 0, short).otherwise(at - 1).cast("int")


def clip_parts(clip: Column) -> Column:
    """struct(recording, start, end) of an id ``recording_start_end``; the recording may hold underscores."""
    part = lambda n: F.regexp_extract(clip, r"^(.*)_([0-9.]+)_([0-9.]+)$", n)
    return F.struct(part(1).alias("recording"), part(2).try_cast("double").alias("start"), part(3).try_cast("double").alias("end"))


def media_type(data: Column) -> Column:
    """An audio format by its first bytes; null if unknown."""
    head = F.hex(F.substring(data, 1, 4))
    return F.when(head == "52494646", "wav").when(head == "664C6143", "flac").when(head == "4F676753", "ogg").when(head.startswith("494433"), "mp3")


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts' JSON, nulls kept."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}), 256)


def filled(template: str, values: dict[str, Column]) -> Column:
    """{name} placeholders replaced in one pass; values aren't expanded again, unknown names stay."""
    out, rest = [], template
    while rest:
        at = min(((rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest), default=None)
        if at is None:
            out.append(F.lit(rest))
            break
        out += [F.lit(rest[: at[0]]), F.coalesce(values[at[1]].cast("string"), F.lit(""))]
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*out) if out else F.lit("")


def unique_labels(labels: Column) -> Column:
    """Labels of an array made different: the second "x" becomes "x (2)", and so on past taken names."""
    return F.aggregate(
        labels,
        F.array().cast("array<string>"),
        lambda done, label: F.array_append(
            done,
            F.when(~F.array_contains(done, label), label).otherwise(
                F.try_element_at(
                    F.filter(F.transform(F.sequence(F.lit(2), F.size(done) + 2), lambda n: F.concat(label, F.lit(" ("), n.cast("string"), F.lit(")"))), lambda c: ~F.array_contains(done, c)),
                    F.lit(1),
                )
            ),
        ),
    )


def longest_common(needle: str, text: str) -> tuple[int, int]:
    """Start in ``text`` and length of the longest common substring: of equals the first in ``needle``, then in ``text``, as difflib has it.

    A substring of length n is common only if some of length n - 1 is, so lengths grow from each start while found.
    """
    size, at = 0, 0
    for i in range(len(needle)):
        while i + size < len(needle) and (found := text.find(needle[i : i + size + 1])) >= 0:
            size, at = size + 1, found
    return at, size


def _fuzzy(needle, text, share: float, least: int):
    if not needle or text is None:
        return None
    if (at := text.find(needle)) >= 0 or (at := text.lower().find(needle.lower())) >= 0:
        return {"start": at, "end": at + len(needle)}
    start, size = longest_common(needle, text)
    if size >= max(least, share * len(needle)):
        return {"start": start, "end": start + size}
    return None


def fuzzy_place(share: float = 0.6, least: int = 4):
    """A pandas UDF (needle, text) -> struct(start, end): exact, else without case, else the longest common substring if long enough, else null."""

    @F.pandas_udf(T.StructType.fromDDL("start int, end int"))
    def run(needle: pd.Series, text: pd.Series) -> pd.DataFrame:
        found = [_fuzzy(n, t, share, least) or {"start": None, "end": None} for n, t in zip(needle, text)]
        return pd.DataFrame(found, columns=["start", "end"]).astype("Int32")

    return run


def sentences(text: Column) -> Column:
    """A text's sentences with their spans: array<struct<text,start,end>>; a sentence ends at . ? or ! before a space and a capital."""
    parts = F.split(text, r"(?U)(?<=[.?!])(?=\s+\p{Lu})")
    kind = "array<struct<text:string,start:int,end:int>>"
    lead = lambda part: F.length(part) - F.length(F.regexp_replace(part, r"(?U)^\s+", ""))
    walked = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found")),
        lambda s, part: F.struct(
            (s["at"] + F.length(part)).alias("at"),
            F.array_append(s["found"], F.struct(F.regexp_replace(part, r"(?U)^\s+", "").alias("text"), (s["at"] + lead(part)).cast("int").alias("start"), (s["at"] + F.length(part)).cast("int").alias("end"))).alias("found"),
        ),
        lambda s: F.filter(s["found"], lambda x: x["text"] != ""),
    )
    return F.coalesce(walked, F.array().cast(kind))


def sentence_of(start: Column, found: Column) -> Column:
    """The index of the sentence (of ``sentences``) that holds a place; null if none does."""
    at = F.array_position(F.transform(found, lambda s: (s["start"] <= start) & (start < s["end"])), True)
    return F.when(at > 0, at - 1).cast("int")


def rule_list(answer: Column) -> Column:
    """The strings of a model's list: the JSON between the first [ and the last ], else all quoted strings."""
    body = F.regexp_replace(F.regexp_replace(without_thoughts(answer), r"```[a-z]*", ""), "[“”]", '"')
    listed = F.from_json(F.regexp_extract(body, r"(?s)\[.*\]", 0), "array<string>")
    quoted = F.regexp_extract_all(body, F.lit(r'"([^"]+)"'), F.lit(1))
    return F.filter(F.transform(F.coalesce(listed, quoted), lambda r: F.trim(r)), lambda r: r != "")


def kinds(value: Column, default: str = "(none)") -> Column:
    """A list of types from JSON text that is a list or one string; blanks go, nothing left gives the default."""
    many = F.from_json(value, "array<string>")
    one = F.array(F.regexp_replace(value, '^"|"$', ""))
    found = F.filter(F.transform(F.when(F.ltrim(value).startswith("["), many).otherwise(one), lambda k: F.trim(k)), lambda k: k.isNotNull() & (k != ""))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def first_path(answer: Column, paths: list[str]) -> Column:
    """The first of some JSON paths that an answer has."""
    return F.coalesce(*(F.get_json_object(answer, p) for p in paths))


def clock(seconds: Column) -> Column:
    """Whole seconds as h:mm:ss."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def _retokenised(words: list[str], edited: str) -> list[str]:
    text = "".join(words)
    owner = [i for i, w in enumerate(words) for _ in w]
    out = [""] * len(words)
    for kind, a, b, c, d in difflib.SequenceMatcher(None, text, edited, autojunk=False).get_opcodes():
        if kind == "equal":
            for x, ch in zip(owner[a:b], edited[c:d]):
                out[x] += ch
        elif d > c and words:  # what is new belongs to the word it replaces, or follows
            out[owner[a] if b > a else owner[max(a - 1, 0)]] += edited[c:d]
    return [w for w in out if w]


@F.pandas_udf(T.ArrayType(T.StringType()))
def retokenised(words: pd.Series, edited: pd.Series) -> pd.Series:
    """An edited text cut into the words it was joined from; words that have vanished are left out."""
    return pd.Series([None if w is None or e is None else _retokenised(list(w), e) for w, e in zip(words, edited)])


# The pairs of quotation marks in explanations, and what may stand between them.
QUOTED = ["'([^'\"‘’“”]{2,80})'", '"([^\'"‘’“”]{2,80})"', "‘([^‘’]{2,80})’", "“([^“”]{2,80})”"]


def quoted(explanation: Column) -> Column:
    """All quoted parts of an explanation, by kind of quotation mark: straight single, straight double, curly single, curly double."""
    return F.coalesce(F.concat(*(F.regexp_extract_all(explanation, F.lit(p), F.lit(1)) for p in QUOTED)), F.array().cast("array<string>"))
