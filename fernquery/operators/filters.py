"""The inline query language: parsed on the driver, compiled to one boolean column (two-valued: what is missing doesn't match)."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, field
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernquery.functions import analyzer, markup

@dataclass
class Context:
    """What the host declares: keys of type number (None: any), and whether dates filter (recency is on)."""

    numeric_keys: set[str] | None = None
    dates: bool = True


@dataclass
class Filters:
    tags: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    properties: dict[str, str] = field(default_factory=dict)
    numeric: list[tuple[str, str, float]] = field(default_factory=list)
    mismatch: list[str] = field(default_factory=list)
    after: str | None = None
    before: str | None = None
    exclude: list[str] = field(default_factory=list)

    def any(self) -> bool:
        return bool(self.tags or self.paths or self.properties or self.numeric or self.mismatch or self.after or self.before or self.exclude)


def number(raw: str | None) -> float | None:
    """A finite number, tolerant of quotes and blanks around it only."""
    text = (raw or "").strip().strip("\"'").strip()
    if regex.fullmatch(r"0[xX][0-9a-fA-F]+", text):
        return float(int(text, 16))
    if not regex.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        return None
    value = float(text)
    return value if math.isfinite(value) else None


def _clean_date(text: str) -> str:
    return text.strip().strip("\"'{}").strip()


def date_ms(text: str | None) -> int | None:
    """The instant that a date names, in UTC: a year, a month, a day (overflowing days roll on), a time stamp, or the first day inside the text."""
    text = _clean_date(text or "")
    if m := regex.fullmatch(r"(\d{4})(?:-(\d{2}))?", text):
        month = int(m[2] or 1)
        return int(dt.datetime(int(m[1]), month, 1, tzinfo=dt.UTC).timestamp() * 1000) if 1 <= month <= 12 else None
    if regex.match(r"\d{4}-\d{2}-\d{2}[T ]\d", text):
        try:
            at = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
            return int((at if at.tzinfo else at.replace(tzinfo=dt.UTC)).timestamp() * 1000)
        except ValueError:
            pass
    if m := regex.search(r"(\d{4})-(\d{2})-(\d{2})", text):
        y, mo, d = map(int, m.groups())
        if 1 <= mo <= 12 and 1 <= d <= 31 and y:
            return int((dt.datetime(y, mo, 1, tzinfo=dt.UTC) + dt.timedelta(days=d - 1)).timestamp() * 1000)
    return None


def end_ms(text: str) -> int | None:
    """The first instant after the period that a date names; a month past 12 rolls on, a bad day doesn't parse."""
    text = _clean_date(text)
    stamp = lambda y, m: int(dt.datetime(y + (m - 1) // 12, (m - 1) % 12 + 1, 1, tzinfo=dt.UTC).timestamp() * 1000)
    if m := regex.fullmatch(r"(\d{4})", text):
        return stamp(int(m[1]) + 1, 1)
    if m := regex.fullmatch(r"(\d{4})-(\d{2})", text):
        return stamp(int(m[1]), int(m[2]) + 1)
    if m := regex.match(r"(\d{4})-(\d{2})-(\d{2})", text):
        mo, d = int(m[2]), int(m[3])
        return stamp(int(m[1]), mo) + d * 86_400_000 if 1 <= mo <= 12 and 1 <= d <= 31 else None
    base = date_ms(text)
    return None if base is None else base + 86_400_000


def _unquoted(s: str) -> str:
    return s[1:-1] if len(s) > 1 and s[0] == s[-1] == '"' else s


def _run(text: str, at: int) -> int:
    """The end of what isn't blank from `at` on."""
    while at < len(text) and text[at] not in markup.BLANKS:
        at += 1
    return at


def _argument(text: str, at: int) -> int:
    """The end of an operator's argument: a quoted text that isn't empty, or what isn't blank."""
    close = text.find('"', at + 1) if text.startswith('"', at) else -1
    return close + 1 if close > at + 1 else _run(text, at)


class _Query:
    """One pass over a raw query. Each `take_*` says where its construct ends, or None if what stands there is text."""

    def __init__(self, raw: str, context: Context):
        self.raw, self.context, self.found, self.dropped = raw, context, Filters(), False

    def negation(self, at: int, end: int) -> bool:
        """A leading minus excludes a word's terms. Negated operators go without effect, so that they can't turn into positive ones."""
        word = self.raw[at + 1 : end]
        if not word:
            return False
        if word[0] in "#[" or ":" in word:
            self.dropped = True
            return True
        terms = [analyzer.singular_text(t) for t in map(analyzer.fold_text, analyzer.tokenize(word)) if t not in analyzer.STOPWORDS]
        self.found.exclude += terms
        return bool(terms)

    def take_bracket(self, text: str, at: int) -> int | None:
        """[key<n], [key>n], [key=n] with or without a colon before the sign, or [key:value]."""
        close = text.find("]", at)
        name_end = markup.run_end(text, at + 1)
        if close < 0 or name_end == at + 1:
            return None
        key, rest = text[at + 1 : name_end], text[name_end:close].lstrip(markup.BLANKS)
        colon = rest.startswith(":")
        value = rest[1:].lstrip(markup.BLANKS) if colon else rest
        if value[:1] in ("<", ">", "=") and len(value) > 1:
            typed = self.context.numeric_keys is None or key in self.context.numeric_keys
            n = number(value[1:]) if typed else None
            if n is None:
                self.found.mismatch.append(key)
            else:
                self.found.numeric.append((key, value[0], n))
        elif colon and len(rest) > 1:
            self.found.properties[key] = value.strip(markup.BLANKS)
        else:
            return None
        return close + 1

    def take_word(self, text: str, at: int) -> int | None:
        """tag:, path:, after:, before: and #tag at the start of a word."""
        name = next((x for x in ("tag:", "path:", "after:", "before:", "#") if text.startswith(x, at)), None)
        if name is None:
            return None
        at += len(name)
        if name in ("tag:", "#"):
            at += name == "tag:" and text.startswith("#", at)
            end = markup.tag_end(text, at)
            if end > at:
                self.found.tags.append(text[at:end])
                return end
            return None
        end = _argument(text, at)
        value = _unquoted(text[at:end])
        if end == at:
            return None
        if name == "path:":
            self.found.paths.append(value)
            return end
        bound = date_ms if name == "after:" else end_ms
        value = value.strip(markup.BLANKS)
        if not self.context.dates or bound(value) is None:
            return None
        setattr(self.found, name[:-1], value)
        return end

    def read(self) -> tuple[str, Filters | None]:
        kept, at = [], 0
        while at < len(self.raw):  # words with a minus first: what they exclude isn't read again
            end = _run(self.raw, at)
            gone = end > at and self.raw[at] == "-" and self.negation(at, end)
            kept.append(" " if gone else self.raw[at:end])
            kept.append(self.raw[end : end + 1])
            at = end + 1
        text, out, at = "".join(kept), [], 0
        while at < len(text):
            end = None
            if text[at] == "[":
                end = self.take_bracket(text, at)
            elif at == 0 or text[at - 1] in markup.BLANKS:
                end = self.take_word(text, at)
            out.append(" " if end else text[at])
            at = end or at + 1
        rest = " ".join("".join(out).split())
        if self.found.any():
            return rest, self.found
        return (rest if self.dropped else self.raw.strip(markup.BLANKS)), None


def parse(raw: str, context: Context | None = None) -> tuple[str, Filters | None]:
    """(text that is left, filters). Without any operator the text is kept as it is, but for blanks at its ends."""
    return _Query(raw, context or Context()).read()


def glob_pattern(glob: str) -> str:
    """`*` is any run, slashes included, `?` one character; the whole path or its end after a slash."""
    body = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c for c in glob)
    return f"(?is)^(?:.*/)?{body}$"


def bind_form(v: Column) -> Column:
    """Lower case with link brackets and alias bars as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(v), "\\[\\[|\\]\\]|\\|", " "), "\\s+", " "))


def display_form(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, "\\[\\[(?:[^\\]|#^]*/)?([^\\]|#^/]*)[^\\]]*\\]\\]", "$1"))


def lookup(properties: Column, key: str) -> Column:
    """Values of a key: its exact spelling first, else the first that equals it without case."""
    same = F.map_filter(properties, lambda k, _: F.lower(k) == key.lower())
    return F.coalesce(F.try_element_at(properties, F.lit(key)), F.get(F.map_values(same), F.lit(0)))


def as_number(v: Column) -> Column:
    text = F.trim(F.regexp_replace(F.trim(v), "^[\"']+|[\"']+$", ""))
    return F.when(text.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double")).when(text.rlike("^0[xX][0-9a-fA-F]{1,13}$"), F.conv(F.substring(text, 3, 20), 16, 10).try_cast("double"))


def _all(parts: list[Column], empty: bool = True) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(empty)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def has_tag(tags: Column, wanted: str) -> Column:
    low = wanted.lower()
    return F.exists(tags, lambda t: (F.lower(t) == low) | F.lower(t).startswith(low + "/"))


def _binds(wanted: Column, exact: bool):
    return lambda v: bind_form(v) == wanted if exact else F.contains(bind_form(v), wanted)


def _compares(op: str, value: float):
    """`>` and `<` include the bound."""

    def test(v: Column) -> Column:
        x = as_number(v)
        return F.coalesce(x >= value if op == ">" else x <= value if op == "<" else x == value, F.lit(False))

    return test


def compile_filters(f: Filters, tags: str = "tags", path: str = "note_path", properties: str = "properties", date: Column | None = None) -> Column:
    """All kinds and together; tags and paths or among themselves. `date` is the chunk's epoch in milliseconds."""
    if f.mismatch:
        return F.lit(False)
    parts: list[Column] = []
    if f.tags:
        parts.append(_any([has_tag(F.col(tags), t) for t in f.tags]))
    if f.paths:
        parts.append(_any([F.col(path).rlike(glob_pattern(g)) for g in f.paths]))
    for key, value in f.properties.items():
        exact = len(value) > 1 and value[0] == value[-1] == '"'
        wanted = bind_form(F.lit(value[1:-1] if exact else value))
        parts.append(F.exists(lookup(F.col(properties), key), _binds(wanted, exact)))
    for key, op, value in f.numeric:
        parts.append(F.exists(lookup(F.col(properties), key), _compares(op, value)))
    if f.after:
        parts.append((date if date is not None else F.lit(None).cast("long")) >= date_ms(f.after))
    if f.before:
        parts.append((date if date is not None else F.lit(None).cast("long")) < end_ms(f.before))
    return _all([F.coalesce(p, F.lit(False)) for p in parts])


def without_notes(chunks: DataFrame, note_terms: DataFrame, excluded: list[str]) -> DataFrame:
    """Drops every chunk of a note any chunk of which holds an excluded term; note_terms: note_path, term."""
    if not excluded:
        return chunks
    bad = note_terms.filter(F.col("term").isin(*excluded)).select("note_path").distinct()
    return chunks.join(bad, "note_path", "left_anti")
