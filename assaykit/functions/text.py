"""Text expressions over specs, programs, chat replies and ids. Each takes and gives Columns."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of the data.
PREAMBLE = "Please based on the following description, create a CAD-Query Code to generate a model:"
MARKER = "\ndescription:\n"
CJK = "[\\u3040-\\u30FF\\u4E00-\\u9FFF]"
DISPLAY_LINE = r"(?m)^\s*#?\s*show_object\(.*$"
IO_LINE = r"(?m)^.*\b(?:exporters|importers|show_object)\b.*$|^.*\.(?:export\w*|save)\(.*$"
NUMBER = r"(-?\d+(?:\.\d+)?)"
TRIPLE = rf"[\[\(]\s*{NUMBER}\s*°?\s*,\s*{NUMBER}\s*°?\s*,\s*{NUMBER}\s*°?\s*[\]\)]"
EULER = rf"(?i)Euler angles[^.\[\(]{{0,40}}?{TRIPLE}"
TRANSLATION = rf"(?i)translation vector[^.\[\(]{{0,40}}?{TRIPLE}"
DIMENSION = rf"(?i)\b%s\b(?: of)?(?: approximately| about)?\s*{NUMBER}"
SYSTEMS = r"(?i)\b(?:new|another|second|third|fourth|fifth|sixth) (?:local )?coordinate system"
ORDINALS = r"(?i)\b(first|second|third|fourth|fifth|sixth|seventh|eighth) part\b"
LITERAL = r"(?<![\w.])-?\d+\.\d+|(?<![\w.])-?\d+(?![\w.])"
TRIVIAL = [0.0, 1.0, 2.0, 90.0, 180.0, 270.0, 360.0]
THINK = r"(?s)<think>.*?</think>"
FENCE = r"(?s)```(?:python|py)?\s*\n(.*?)```"
NAMED = r"(?:dimensions of (?:the|this) |resulting |[Tt]he final )([a-z][a-z\- ]{2,30}?) (?:will|are|is|has|have|measures)"
NOUNS = (
    "block|bar|plate|prism|box|cube|cylinder|rod|pipe|tube|ring|disk|disc|washer|bracket|beam|panel|frame|flange|"
    "shaft|cap|slab|wedge|cone|column|post|bolt|nut|gear|housing|bushing|spacer|sleeve|hinge|clip|mount|rail|channel|"
    "star|hexagon|triangle|arch|bowl|cup|knob|handle|leg|table|chair|shelf|stand|holder|support|cover|lid|tray|container"
)
TITLE = rf"(?i)\b((?:(?!new |first |second |final |the |a |an )[a-z\-]+ ){{0,2}}(?:{NOUNS}))s?\b"
CONTENT_TYPES = ["text", "image"]
SPACES = " \t\n\r\f\x0b"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def spec_text(user: Column) -> Column:
    """What follows the marker; else the text without the preamble; trimmed."""
    at = F.instr(user, MARKER)
    return strip(F.when(at > 0, F.substr(user, at + len(MARKER))).when(user.startswith(PREAMBLE), F.substr(user, F.lit(len(PREAMBLE) + 1))).otherwise(user))


def strip_io(code: Column) -> Column:
    return F.regexp_replace(code, IO_LINE, "")


def clean_program(code: Column) -> Column:
    """Null for placeholder rows; else the program without display lines and long gaps."""
    usable = ~F.regexp_like(code, F.lit(CJK)) & (code.contains("cadquery") | code.contains("cq."))
    bare = strip_io(F.regexp_replace(code, DISPLAY_LINE, ""))
    return F.when(usable, F.concat(strip(F.regexp_replace(bare, r"\n{3,}", "\n\n")), F.lit("\n")))


def triples(text: Column, pattern: str) -> Column:
    """array<array<double>> of all matches of a pattern with three number groups."""
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "abc")]), lambda z: F.array(*[z[n].cast("double") for n in "abc"]))


def stated_dims(text: Column) -> Column:
    """Lengths, widths and heights paired by position, cut to the shortest list."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(DIMENSION % name), F.lit(1)), lambda x: x.cast("double")) for name in ("length", "width", "height")]
    n = F.least(*[F.size(x) for x in found])
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array(*[F.get(x, i - 1) for x in found]))).otherwise(F.array().cast("array<array<double>>"))


def part_count(text: Column) -> Column:
    """Ordinals count once for each spelling, upper and lower case apart."""
    ordinals = F.array_distinct(F.regexp_extract_all(text, F.lit(ORDINALS), F.lit(1)))
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(SYSTEMS)), F.size(ordinals))


def all_near_zero(rows: Column) -> Column:
    """True for array<array<double>> without a value of 1e-9 or more; true if empty."""
    return F.forall(F.flatten(rows), lambda v: F.abs(v) < 1e-9)


def numbers(text: Column) -> Column:
    """Distinct absolute values of the number literals, to four places."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LITERAL), F.lit(0)), lambda x: F.round(F.abs(x.cast("double")), 4)))


def spec_coverage(spec: Column, code: Column) -> Column:
    """Share of the program's non-trivial numbers that the spec states, within 0.2 % or 1e-4; 1 if it has none."""
    given = numbers(spec)
    needed = F.filter(numbers(code), lambda x: ~x.isin(TRIVIAL))
    met = F.filter(needed, lambda a: F.exists(given, lambda b: F.abs(a - b) <= F.greatest(F.lit(1e-4), 0.002 * F.abs(a))))
    return F.when(F.size(needed) == 0, 1.0).otherwise(F.size(met) / F.greatest(F.size(needed), F.lit(1)))


def normalized_program(code: Column) -> Column:
    """Without comments, outer spaces and blank lines."""
    lines = F.transform(F.split(code, "\r\n|\r|\n"), lambda x: strip(F.regexp_replace(x, "#.*$", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def last_program(reply: Column) -> Column:
    """The last fenced block that names the modelling library, else what follows a bare import of it, else null."""
    text = F.regexp_replace(reply, THINK, "")
    blocks = F.filter(F.regexp_extract_all(text, F.lit(FENCE), F.lit(1)), lambda b: b.contains("cq") | b.contains("cadquery"))
    at = F.instr(text, "import cadquery")
    return F.when(F.size(blocks) > 0, F.concat(strip(F.element_at(blocks, -1)), F.lit("\n"))).when(at > 0, F.concat(strip(F.substr(text, at)), F.lit("\n")))


def fenced(code: Column) -> Column:
    return F.concat(F.lit("```python\n"), strip(code), F.lit("\n```"))


def tidy(code: Column) -> Column:
    """Without trailing lines that are blank, comments, prints or a lone name."""
    return F.concat(F.regexp_replace(strip(code), r"(?:\n[ \t]*(?:#[^\n]*|print\([^\n]*\)|[A-Za-z_]\w*)?[ \t]*)+$", ""), F.lit("\n"))


def title(spec: Column, n_parts: Column) -> Column:
    """The last name that the spec gives the part, else its first noun for a part, capitalised, with the number of parts if several."""
    named = F.array_compact(F.regexp_extract_all(spec, F.lit(NAMED), F.lit(1)))
    told = F.when(F.size(named) > 0, F.element_at(named, -1))
    noun = F.nullif(F.regexp_extract(spec, TITLE, 1), F.lit(""))
    name = F.coalesce(F.when(~told.isin("part", "dimensions", "shape", "model"), told), noun, F.lit("part"))
    name = F.regexp_replace(F.trim(name), "^(?:final |dimensions of (?:the |this )?)+", "")
    head = F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substr(name, F.lit(2))))
    return F.when(n_parts == 1, head).otherwise(F.concat(head, F.lit(" ("), n_parts.cast("string"), F.lit(" parts)")))


def box_request(x: Column, y: Column, z: Column) -> Column:
    return F.format_string("Bounding box: X %.4f, Y %.4f, Z %.4f. Write the CadQuery program for this part.", x, y, z)


def file_name(item_id: Column) -> Column:
    return F.translate(item_id, ":/", "__")


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix; a name that begins with its only dot stays."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?/*$", 1)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def short_error(error: Column, prefix: str = "", limit: int = 300) -> Column:
    return F.concat(F.lit(prefix), F.substring(error, 1, limit))


def percent(x: Column, places: int = 1) -> Column:
    return F.coalesce(F.format_string(f"%.{places}f%%", x * 100), F.lit("–"))


def fixed(x: Column, places: int = 2) -> Column:
    return F.coalesce(F.format_string(f"%.{places}f", x), F.lit("–"))


def money(x: Column) -> Column:
    """Four places below a cent."""
    return F.when(x.isNull(), "–").when(x < 0.01, F.format_string("$%.4f", x)).otherwise(F.format_string("$%.2f", x))


def chat_messages(system: str, spec: Column, shots: Column | None = None) -> Column:
    """array<struct<role, content>>: system, each shot (struct spec, gold_code) as a turn pair, then the spec."""
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    first, last = F.array(one("system", F.lit(system))), F.array(one("user", spec))
    if shots is None:
        return F.concat(first, last)
    pairs = F.flatten(F.transform(shots, lambda s: F.array(one("user", s["spec"]), one("assistant", fenced(s["gold_code"])))))
    return F.concat(first, pairs, last)


def content_parts(content: Column) -> Column:
    """A message's content as an array of typed parts; a plain text becomes one part."""
    return F.array(F.struct(F.lit("text").alias("type"), content.alias("text")))


def checked_parts(parts: Column) -> Column:
    """An array of parts (type, text), or an error if one has a type that no model takes."""
    known = F.transform(parts, lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text")))
    odd = F.filter(parts, lambda p: ~p["type"].eqNullSafe(F.lit(CONTENT_TYPES[0])) & ~p["type"].eqNullSafe(F.lit(CONTENT_TYPES[1])))
    return F.when(F.size(odd) > 0, F.raise_error(F.concat(F.lit("unsupported content part type "), F.coalesce(odd[0]["type"], F.lit("null"))))).otherwise(known)


def run_name(created: Column, tag: Column) -> Column:
    """The name of a run's folder, which sorts by time."""
    return F.concat(F.date_format(created, "yyyyMMdd-HHmmss"), F.lit("_"), tag)


def iso_seconds(created: Column) -> Column:
    return F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss")


def session_key(lane: Column, slot: Column, sessions: int = 4) -> Column:
    """The session that the calls of a slot share, for caches on the other side."""
    return F.concat(F.lit("cad-"), lane, F.lit("-"), F.pmod(slot, F.lit(sessions)).cast("string"))


def messages_length(messages: Column) -> Column:
    return F.aggregate(F.transform(messages, lambda m: F.length(m["content"])), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))


def fits(messages: Column, images: Column, most_tokens: int, image_tokens: int = 256) -> Column:
    """Whether messages and images stay within a number of tokens, four characters counted as one."""
    return F.ceil(messages_length(messages) / 4) + F.size(images) * image_tokens <= most_tokens


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text by the tokenizer file at path, which each worker loads once; null texts have none."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(path)
        encoder.no_truncation()
        for texts in batches:
            yield pd.Series([len(x.ids) for x in encoder.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)])

    return of(text)


def fits_tokens(messages: Column, images: Column, most_tokens: int, path: str, image_tokens: int = 256) -> Column:
    """Whether messages and images stay within a number of tokens, counted by a tokenizer."""
    said = F.array_join(F.transform(messages, lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit("\n"), F.coalesce(m["content"], F.lit("")))), "\n")
    return token_count(said, path) + F.size(images) * image_tokens <= most_tokens


def with_typos(text: Column, item: Column, variant: int, seed: int = 13, rate: float = 0.06) -> Column:
    """The text with neighbouring letters swapped in some words, and its blocks after the first in another order.

    Every draw is keyed on seed, item and variant, so a run can be taken up again.
    """

    @F.pandas_udf("string")
    def of(texts: pd.Series, items: pd.Series) -> pd.Series:
        out = []
        for said, key in zip(texts, items):
            draw = random.Random(f"{seed}/{key}/{variant}")

            def noisy(match: re.Match, draw: random.Random = draw) -> str:
                word = match[0]
                if len(word) < 4 or draw.random() >= rate:
                    return word
                at = draw.randint(1, len(word) - 3)
                return word[:at] + word[at + 1] + word[at] + word[at + 2 :]

            first, *blocks = re.sub(r"(?<!\S)[^\W\d_]+(?!\S)", noisy, said or "").split("\n\n")
            draw.shuffle(blocks)
            out.append("\n\n".join([first, *blocks]))
        return pd.Series(out)

    return of(text, item)


def is_fatal(error: Column) -> Column:
    """An error of the account, after which every further call would fail."""
    return F.coalesce(F.regexp_like(error, F.lit("402|401|403|payment")), F.lit(False))
