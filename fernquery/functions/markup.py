"""Scanners over Markdown text: one position that moves forward, constructs recognised by what stands there. No DataFrame code.

`Prose` turns inline markup into what a reader sees and keeps what is lost; `tag_end` and `tags_in` know the tag grammar; `masked`
blanks what doesn't show as body text; `plain_snippet` is for result rows.
"""

from __future__ import annotations

import re
import string

# Which characters end a tag, which files have no text to show, and which blanks count. Results depend on them.
TAG_BREAKS = frozenset(string.punctuation) - {"-", "_"}
TAG_BREAK_BLOCKS = ((0x2000, 0x206F), (0x2E00, 0x2E7F))
ASSET_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".bmp", ".tif", ".tiff", ".pdf", ".mp4", ".mov", ".webm", ".mkv", ".mp3", ".m4a", ".wav", ".zip")
BLANKS = " \t\n\v\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# End of fixed values.

_INLINE_BLANKS = re.compile(f"[{re.escape(BLANKS.replace(' ', '').replace(chr(10), ''))}]")
_MARKS = re.compile(r"[!\[<]|[hH](?=[tT][tT][pP])")


def is_asset(name: str) -> bool:
    return name.lower().endswith(ASSET_SUFFIXES)


def tag_char(c: str) -> bool:
    return c not in BLANKS and c not in TAG_BREAKS and not any(lo <= ord(c) <= hi for lo, hi in TAG_BREAK_BLOCKS)


def run_end(text: str, at: int) -> int:
    """The end of the tag characters that start at `at`."""
    while at < len(text) and tag_char(text[at]):
        at += 1
    return at


def tag_end(text: str, at: int) -> int:
    """The end of the tag (segments between single slashes) that starts at `at`; `at` itself if there is none."""
    end = run_end(text, at)
    while end > at and text.startswith("/", end) and (more := run_end(text, end + 1)) > end + 1:
        end = more
    return end


def _without_comments(text: str) -> str:
    """`%%` opens and closes comments in turn; one that is still open at the end hides the rest."""
    parts = text.split("%%")
    shown = parts[0::2]
    return ".".join(shown)


def _without_code(line: str) -> str:
    parts = line.split("`")
    if len(parts) % 2 == 0:  # the last tick opens nothing
        parts[-2:] = [parts[-2] + "`" + parts[-1]]
    return ".".join(parts[0::2])


def tags_in(prose: str) -> list[str]:
    """Tags of prose without fences, in order: comments and code spans hold none, nor do digits alone make one; the first spelling stays."""
    plain = "\n".join(map(_without_code, _without_comments(prose).split("\n")))
    found: dict[str, str] = {}
    at = plain.find("#")
    while at >= 0:
        end = tag_end(plain, at + 1)
        tag = plain[at + 1 : end]
        if (at == 0 or plain[at - 1] in BLANKS) and tag.strip("0123456789/"):
            found.setdefault(tag.lower(), tag)
        at = plain.find("#", max(end, at + 1))
    return list(found.values())


def display(inner: str, embed: bool = False) -> str:
    """What a reader sees of a wiki link's inside: the alias, or the last segment of the target."""
    target, bar, alias = inner.partition("|")
    if bar:
        return alias.strip(BLANKS)
    for mark in "#^":
        target = target.partition(mark)[0]
    if embed and is_asset(target.strip(BLANKS)):
        return ""
    return target.rpartition("/")[2].strip(BLANKS)


def canonical(inner: str) -> str:
    """The last segment of a wiki link's target, whatever its alias."""
    return display(inner.partition("|")[0])


def address_words(url: str) -> str:
    """The readable words of an address: no scheme, www, top-level domain, query or fragment."""
    rest = url.partition("://")[2] if url.lower().startswith(("http://", "https://")) else url
    if rest.lower().startswith("www."):
        rest = rest[4:]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, _, path = rest.partition("/")
    name, dot, top = host.rpartition(".")
    if dot and 2 <= len(top) <= 24 and top.isascii() and top.isalpha():
        host = name
    return " ".join("".join(c if c.isalnum() else " " for c in f"{host} {path}").split())


class Prose:
    """One text's inline markup. `lost` holds (kind, text) of what readers don't see, kinds in the order in which an index takes them."""

    EMBED, IMAGE, WIKI, LINK, AUTOLINK, ADDRESS = range(6)

    def __init__(self) -> None:
        self.lost: list[tuple[int, str]] = []

    def lose(self, kind: int, text: str) -> None:
        if text := text.strip(BLANKS):
            self.lost.append((kind, text))

    def lost_text(self) -> str:
        return " ".join(t for _, t in sorted(self.lost, key=lambda x: x[0]))

    def read(self, text: str) -> str:
        out, at, plain = [], 0, 0
        while mark := _MARKS.search(text, at):
            at = mark.start()
            if step := self._construct(text, at):
                out += [text[plain:at], step[1]]
                at = plain = step[0]
            else:
                at += 1
        return "".join([*out, text[plain:]])

    def _construct(self, text: str, at: int) -> tuple[int, str] | None:
        """(its end, what is seen of it) of the construct that starts here."""
        c = text[at]
        if c == "!":
            return self._wiki(text, at + 1, True) or self._link(text, at + 1, self.IMAGE) if text.startswith("[", at + 1) else None
        if c == "[":
            return self._wiki(text, at, False) or self._link(text, at, self.LINK)
        if c == "<":
            return self._angle(text, at)
        return self._address(text, at)

    def _wiki(self, text: str, at: int, embed: bool) -> tuple[int, str] | None:
        if not text.startswith("[[", at):
            return None
        end = text.find("]", at + 2)
        if end < at + 3 or not text.startswith("]]", end):
            return None
        inner = text[at + 2 : end]
        seen = display(inner, embed)
        target = inner.partition("|")[0].strip(BLANKS)
        if target != seen:
            self.lose(self.EMBED if embed else self.WIKI, target)
        return end + 2, self.read(seen)

    def _link(self, text: str, at: int, kind: int) -> tuple[int, str] | None:
        label = self._label_end(text, at + 1)
        if label < 0 or not text.startswith("(", label + 1):
            return None
        end = text.find(")", label + 2)
        if end < 0:
            return None
        seen = self.read(text[at + 1 : label]).strip(BLANKS)
        self.lose(kind, text[label + 2 : end])
        return end + 1, seen

    @staticmethod
    def _label_end(text: str, at: int) -> int:
        """Where the bracket closes; wiki links and images inside a label have brackets of their own."""
        while (close := text.find("]", at)) >= 0:
            inner = text.rfind("[", at, close)
            wiki = inner > at and text[inner - 1] == "[" and text.startswith("]]", close)
            image = inner > at and text[inner - 1] == "!" and text.startswith("](", close)
            if wiki:
                at = close + 2
            elif image and (shut := text.find(")", close)) >= 0:
                at = shut + 1
            else:
                return close
        return -1

    def _angle(self, text: str, at: int) -> tuple[int, str] | None:
        head = at + 2 if text.startswith("/", at + 1) else at + 1
        end = text.find(">", at)
        if end < 0 or not (text[head : head + 1].isascii() and text[head : head + 1].isalpha()):
            return None
        inner = text[at + 1 : end]
        if inner.lower().startswith(("http://", "https://")) and len(inner.partition("://")[2]) and not any(b in inner for b in BLANKS):
            self.lose(self.AUTOLINK, inner)
        return end + 1, " "

    def _address(self, text: str, at: int) -> tuple[int, str] | None:
        head = text[at : at + 8].lower()
        if not head.startswith(("http://", "https://")) or at and (text[at - 1].isascii() and text[at - 1].isalnum() or text[at - 1] == "_"):
            return None
        start = end = at + head.index("://") + 3
        while end < len(text) and text[end] not in BLANKS and text[end] not in ")<>]":
            end += 1
        if end == start:
            return None
        self.lose(self.ADDRESS, text[at:end])
        return end, address_words(text[at:end])


def tidy(text: str) -> str:
    """Rules go, blanks collapse, and no more than one empty line stands between others."""
    out: list[str] = []
    for line in _INLINE_BLANKS.sub(" ", text).split("\n"):
        dense = line.replace(" ", "")
        if len(dense) > 2 and dense[0] in "-*_" and dense == dense[0] * len(dense):
            line = ""
        line = " ".join(x for x in line.split(" ") if x)
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip(BLANKS)


def masked(text: str) -> str:
    """The text at its own length, with blanks for what doesn't show as body text: front matter, embeds, code, and all of a wiki link but what is seen."""
    out = list(text)

    def hide(lo: int, hi: int) -> None:
        out[lo:hi] = ["\n" if c == "\n" else " " for c in out[lo:hi]]

    if text.startswith("---\n") and (end := text.find("\n---", 3)) >= 0:
        hide(0, end + 4)
    at = text.find("[[")
    while at >= 0:
        end = text.find("]", at + 2)
        if end < 0:
            break
        if not text.startswith("]]", end):
            at = text.find("[[", at + 1)
            continue
        bar = text.find("|", at, end)
        if at and text[at - 1] == "!":
            hide(at - 1, end + 2)
        else:
            hide(at, bar + 1 if bar >= 0 else at + 2)
            hide(end, end + 2)
        at = text.find("[[", end + 2)
    open_ = text.find("`")
    while open_ >= 0 and (close := text.find("`", open_ + 1)) >= 0:
        hide(open_, close + 1)
        open_ = text.find("`", close + 1)
    return "".join(out)


def _word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def highlight_spans(text: str, tokens: list[str], stopwords: frozenset[str] = frozenset(), start: int = 0, stop: int | None = None, most: int = 32) -> list[tuple[int, int]]:
    """Sorted, disjoint spans of whole words that begin with a token, at most `most` for each; one-character tokens and stopwords have none."""
    low = masked(text).lower()
    if len(low) != len(text):  # a letter whose lower case is longer would shift the offsets
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in masked(text))
    stop = len(text) if stop is None else stop
    spans: list[tuple[int, int]] = []
    for token in tokens:
        if len(token) < 2 or token in stopwords:
            continue
        found, at = 0, low.find(token, start)
        while 0 <= at < stop and found < most:
            edge = _word(token[0]) != (at > 0 and _word(low[at - 1]))
            end = at + len(token)
            if edge:
                while end < len(low) and _word(low[end]):
                    end += 1
                spans.append((at, end))
                found += 1
            at = low.find(token, end if edge else at + 1)
    out: list[tuple[int, int]] = []
    for span in sorted(spans, key=lambda s: s[0]):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def _is_rule(line: str) -> bool:
    cells = [c.strip(BLANKS).removeprefix(":").removesuffix(":") for c in line.strip(BLANKS).removeprefix("|").removesuffix("|").split("|")]
    return len(cells) > 1 and all(c and not c.strip("-") for c in cells)


def _cells(row: str) -> str:
    return " · ".join(c for c in (x.strip(BLANKS) for x in row.strip(BLANKS).removeprefix("|").removesuffix("|").split("|")) if c)


def plain_snippet(text: str) -> str:
    """A snippet for a result row: no display formulas, embeds, images, tables or fence lines. If nothing else is there, tables and formulas in one line."""
    formulas: list[str] = []
    parts = text.split("$$")
    if len(parts) % 2 == 0:
        parts[-2:] = ["$$".join(parts[-2:])]
    formulas = [" ".join(p.split()) for p in parts[1::2]]
    rest = _drop_embeds("".join(parts[0::2]))
    rows, kept = [], []
    for line in rest.split("\n"):
        bare = line.strip(BLANKS)
        if _is_rule(line):
            continue
        if len(bare) > 1 and bare[0] == bare[-1] == "|":
            rows.append(bare)
        else:
            kept.append("" if bare.startswith(("```", "~~~")) else line)
    shown = "\n".join(kept)
    while "\n\n\n" in shown:
        shown = shown.replace("\n\n\n", "\n\n")
    if shown := shown.strip(BLANKS):
        return shown
    flat = ["  |  ".join(x for x in map(_cells, rows) if x), "  ".join(f for f in formulas if f)]
    return "  —  ".join(x for x in flat if x)


def _drop_embeds(text: str) -> str:
    out, at = [], 0
    while (mark := text.find("![", at)) >= 0:
        end = -1
        close = text.find("]", mark + 2)
        if text.startswith("[", mark + 2) and close >= 0 and text.startswith("]]", close):
            end = close + 2
        elif close >= 0 and text.startswith("(", close + 1) and (shut := text.find(")", close)) >= 0:
            end = shut + 1
        out.append(text[at:mark] if end >= 0 else text[at : mark + 2])
        at = end if end >= 0 else mark + 2
    return "".join([*out, text[at:]])
