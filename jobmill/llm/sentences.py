"""Sentence units of documents in many languages and scripts.

Lines give the outer structure: headings, list items and label lines are units, paragraphs may be wrapped. Whether a
document is wrapped is weighed from its own lines (do they break where the next word wouldn't have fit, do they go on in
lower case) and from the widths at which the corpus is wrapped. Inside a paragraph every character is tagged as boundary or
inside by a linear-chain model and Viterbi decoding; characters that no script ends a sentence at (neither sentence
terminals by Unicode's property, nor blanks beside a script written without them) are inside for certain, so that the chain
runs over the others. The model is trained on all of the corpus' own list items: set one after another they are a paragraph whose
boundaries are known. For scripts without end marks the items' punctuation is stripped first, so that blanks alone must tell.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill.session import cut, spread

TRAIN_BLOCKS = 5_000  #: the most lists, for each group of scripts, that the training begins with on the driver; then it goes on with all
TRAIN_LIST = 20_000  #: characters from which a list is trained on in runs of whole items
SHARD_LISTS, SHARD_CHARS = 5_000, 5_000_000  #: about the most lists, and characters of lists, in a shard of the training
ROUNDS = 25  #: passes of the training's beginning
SHARD_ROUNDS = 5  #: passes over a shard
SURE = 3.0  #: log odds from which a document's own lines decide whether it is wrapped, and teach the widths
WIDTH_STEP = 5  #: characters to a class of line widths
MEMO = 200_000  #: scored contexts that a worker remembers

#: Marks that may end a sentence in any script (Unicode's property), and the ellipsis.
ENDS = "".join(regex.findall(r"\p{Sentence_Terminal}", "".join(map(chr, range(0x20000))))) + "…"
_END = frozenset(ENDS)

# What may open and close around sentences.
OPENERS = "([{（［｛【「『《〈«‹“„‘‚"
CLOSERS = ")]}）］｝】」』》〉»›”’"
PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "］": "［", "｝": "｛", "】": "【", "」": "「", "』": "『", "》": "《", "〉": "〈", "»": "«", "›": "‹"}

# Scripts in which a blank may end a sentence (Thai, Lao, Khmer, Myanmar); the last two have marks of their own.
UNMARKED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
OWN_MARKS = "\u17d4\u17d5\u104a\u104b"

MARKER = re.compile(r"[^\S\n]*(?:#{1,6}(?=\s)|[-*+•–—·‣▪◦●○](?=\s)|\(?\d{1,3}[.)](?=\s)|\(?[a-z]\)(?=\s)|[①-⑳])\s*")
LABEL = re.compile(r"[^\s.!?。！？:：][^.!?。！？:：]{0,29}?\s?[:：](?=\s*\S)")
_LINES = re.compile("\r\n|[\n\r\u2028\u2029\x0b\x0c\x85]")
_CANDIDATE = re.compile(rf"[{re.escape(ENDS)}]+|(?<=[{UNMARKED}0-9A-Za-z.)\"”’])\s+(?=\S)")
_MARK_ONLY = re.compile(rf"[{re.escape(ENDS)}]+")
_ASCII_MARK = re.compile(r"[.?!]+")
_DOTS = re.compile(r"\.{2,}|…+")
_UNMARKED = re.compile(f"[{UNMARKED}]")
_OWN_MARK = re.compile(f"[{OWN_MARKS}]")
_ENCLOSING = re.compile("[" + re.escape('"“”' + "".join(PAIRS) + "".join(c for c in OPENERS if c not in "‘‚")) + "]")


def script(c: str) -> str:
    """A coarse class of a character."""
    o = ord(c)
    if o < 128:
        return "U" if c.isupper() else "l" if c.isalpha() else "d" if c.isdigit() else "s" if c.isspace() else "o" if c in "([{\"" else "p"
    if 0x0E00 <= o <= 0x0EFF or 0x1000 <= o <= 0x109F or 0x1780 <= o <= 0x17FF:
        return "t"
    if 0x0900 <= o <= 0x0DFF:
        return "h"
    if 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF or 0x20000 <= o <= 0x3FFFF:
        return "c"
    if c in OPENERS:
        return "o"
    if c.isspace():
        return "s"
    return "U" if c.isupper() else "l" if c.islower() else "a" if c.isalpha() else "d" if c.isdigit() else "p"


_script = lru_cache(maxsize=100_000)(script)


# --- lines -----------------------------------------------------------------------------------------------------


def _split(text: str) -> list[tuple[int, int, bool, int]]:
    """(from, to, marked, start) of every line: what stands in it behind its marker, and where the line itself starts."""
    lines, at = [], 0
    for m in [*_LINES.finditer(text), None]:
        end = m.start() if m else len(text)
        marker = MARKER.match(text, at, end)
        start = marker.end() if marker else at
        body = text[start:end]
        left = start + len(body) - len(body.lstrip())
        lines.append((left, max(left, start + len(body.rstrip())), bool(marker), at))
        at = m.end() if m else end
    return lines


def wrapping(text: str, lines: list[tuple[int, int, bool, int]]) -> tuple[int, float]:
    """(width, log odds) of the likeliest width that a text is wrapped at, by its own lines.

    Only lines that another one follows at once tell anything. A wrapped line breaks because the next word wouldn't have fit
    into the width; by chance a line does so about as often as a word has a share of the width. Lines that go on in lower
    case speak for wrapping, those that go on in upper case against it, unless a sentence has ended. The width is the longest
    line's, or one of the next ones', so that a few longer lines don't matter.
    """
    breaks = []  # (length, what the next word would have added, does the next line start in lower case)
    for (a, b, marked, _), (c, d, marked2, _) in zip(lines, lines[1:]):
        if a < b and c < d and not marked and not marked2:
            word = re.match(r"\S*", text[c : min(d, c + 80)])[0]
            first = _script(text[c])
            ended = text[b - 1] in _END
            breaks.append((b - a, 1 + len(word), 0.0 if ended or first not in "lU" else 2.5 if first == "l" else -0.7))
    if not breaks:
        return 0, 0.0
    best = None
    last = [b - a for (a, b, marked, _), nxt in zip(lines, [*lines[1:], (0, 0, False, 0)]) if b > a and not marked and nxt[0] >= nxt[1]]
    sizes = sorted({n for n, _, _ in breaks} | {n for n in last if n <= max(x[0] for x in breaks)}, reverse=True)[:3]
    for width in sizes:
        odds, top = 0.0, False
        for n, more, case in breaks:
            if n > width:
                odds -= 1.0
                continue
            chance = min(0.7, more / width)
            if n + more <= width:  # a heading or a paragraph's end, in a wrapped text too
                odds += math.log(0.3 / (1 - chance)) + max(case, 0.0)
                continue
            odds += case
            if n == width and not top:  # the longest line is full by itself
                top = True
                continue
            odds += math.log(0.7 / chance)
        if best is None or odds > best[1]:
            best = width, odds
    return best


def blocks(text: str, widths: dict[int, float] | None = None) -> list[tuple[str, int, int]]:
    """("unit" or "paragraph", from, to) of a text, markers and outer white space left out.

    An empty line ends a paragraph, and so does every other line break unless the line is full, that is, unless the
    text is wrapped and the next line's first word didn't fit into its width. widths: the log odds that the corpus gives to
    wrapping at a width, by its class; they count besides the text's own.
    """
    lines = _split(text)
    width, odds = wrapping(text, lines) if len(lines) > 1 else (0, 0.0)
    wrapped = width > 0 and odds + (widths or {}).get(width // WIDTH_STEP, 0.0) > 0
    out: list[tuple[str, int, int]] = []
    open_from = open_to = -1
    open_line = 0

    def close() -> None:
        nonlocal open_from
        if open_from >= 0:
            out.append(("paragraph", open_from, open_to))
        open_from = -1

    for a, b, marked, line_at in lines:
        full = open_from >= 0 and wrapped and text[open_to - 1] not in _END
        if full and marked:  # only a number at the start of a wrapped line can look like an item's
            full = bool(re.match(r"\d{1,3}\.", text[line_at:a])) and _script(text[open_to - 1]) in "lUd"
        if full:
            begin = a if not marked else line_at
            word = re.match(r"\S*", text[begin:b])[0] if b > a else ""
            length = len(text[open_line:open_to].strip())
            full = b > a and length <= width < length + 1 + len(word)
        if marked and full:  # a wrapped line that only looks like an item
            open_to, open_line = b, line_at
            continue
        if a >= b:
            close()
        elif marked:
            close()
            out.append(("unit", a, b))
        elif open_from >= 0 and (full or (wrapped and text[open_to - 1] in _END)):
            open_to, open_line = b, line_at
        else:
            close()
            if LABEL.match(text, a, b) and b - a <= 60 and text[b - 1] not in _END:
                out.append(("unit", a, b))
            else:
                open_from, open_to, open_line = a, b, line_at
    close()
    return out


# --- characters ------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _kinds(text: str) -> tuple[bool, bool]:
    """Whether a text has characters of UNMARKED scripts, and whether marks of their own."""
    return _UNMARKED.search(text) is not None, _OWN_MARK.search(text) is not None


def candidates(text: str, start: int, end: int) -> list[tuple[int, str, bool, int]]:
    """(boundary, mark, closed, mark_from) of every place of a paragraph where a sentence may end.

    The boundary lies behind the marks and whatever closes after them; `closed`: inside no quotation or bracket.
    """
    depth = _depths(text, start, end)
    unmarked, own = (False, False) if text.isascii() else _kinds(text)
    find = _ASCII_MARK if text.isascii() else _CANDIDATE if unmarked else _MARK_ONLY
    out = []
    at = start
    while (m := find.search(text, at, end)) is not None:
        at = m.end()
        if m[0][0] in _END:
            stop = m.end()
            while stop < end:
                c = text[stop]
                if c in CLOSERS or c in _END or (c in "\"“'" and depth and depth[stop - start] < depth[stop - start - 1]):
                    stop += 1
                elif c.isspace() and stop + 1 < end and text[stop + 1] in "»›" and depth and depth[stop + 1 - start] < depth[stop - start]:
                    stop += 2
                else:
                    break
            at = max(at, stop)
            mark = m[0] if len(m[0]) == 1 else _DOTS.sub("…", m[0])[:3]
            out.append((stop, mark, not depth or depth[stop - start - 1] == 0, m.start()))
        else:
            before, after = text[m.start() - 1], text[m.end()]
            if _script(before) == "t" or _script(after) == "t":
                if own and not (0x0E00 <= ord(before) <= 0x0EFF or 0x0E00 <= ord(after) <= 0x0EFF):
                    continue  # a script with end marks, and they are used
                out.append((m.start(), " ", not depth or depth[m.start() - start - 1] == 0, m.start()))
    return out


def _depths(text: str, start: int, end: int) -> list[int]:
    """How many closed pairs of quotes or brackets each character lies in; a pair's own opener counts, its closer not. Empty
    where there are none at all."""
    change = None
    stack: list[tuple[str, int]] = []
    for m in _ENCLOSING.finditer(text, start, end):
        i, c = m.start(), m[0]
        if c in '"“”':
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == ("q" if c == '"' else "„" if c == "“" else "“")), None)
            if k is None and c == "”":
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "„"), None)
            if k is None and c != "”":
                stack.append(("q" if c == '"' else "“", i))
        elif c in PAIRS:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == PAIRS[c]), None)
        else:
            k = None
            stack.append((c, i))
        if k is not None:
            if change is None:
                change = [0] * (end - start + 1)
            change[stack[k][1] - start] += 1
            change[i - start] -= 1
            del stack[k:]
    return [] if change is None else list(itertools.accumulate(change))


def context(text: str, start: int, end: int, candidate: tuple[int, str, bool, int]) -> tuple:
    """What a candidate is judged by: mark, closed, whether anything closes after the mark, whether a blank follows, the token
    before, the last characters before and the first ones after, as far as features look at them."""
    stop, mark, closed, mark_from = candidate
    left = text[max(start, mark_from - 14) : mark_from]
    after = stop
    while after < end and text[after].isspace():
        after += 1
    right = text[after : min(end, after + 10)]
    token = _TOKEN.search(left)[0]
    if mark == " " or _script(left[-1:] or " ") in "ct" or _script(right[:1] or " ") in "ct":
        before, behind = left[-4:], right
    else:
        before, behind = left[-1:], right[:4]
    return mark, closed, stop > mark_from + len(mark) or (stop > mark_from + 1 and text[stop - 1] not in _END), after > stop, token, before, behind


_MARKS = re.compile(r"[.?!…]")
_TOKEN = re.compile(r"[^\s(\[{（「『“„«\"]*$")


def features(ctx: tuple) -> list[str]:
    """The names of a context's features."""
    mark, closed, shut, blank, token, left, right = ctx
    nxt = _script(right[0]) if right else "-"
    low = token.lower()
    prv = _script(left[-1]) if left else "-"
    shape = "".join(dict.fromkeys(map(_script, token))) if len(token) > 1 else prv
    size = min(len(token), 4)
    base = f"{mark}{int(blank)}"
    out = [
        f"m{base}", f"q{mark}{int(closed)}", f"s{int(shut)}{nxt}{mark}", f"n{base}{nxt}", f"p{mark}{prv}{nxt}{int(blank)}", f"h{mark}{shape}{size}{nxt}", f"h2{mark}{shape}{size}",
        f"w{mark}{low[-12:]}", f"wn{mark}{low[-12:]}{nxt}", f"wl{mark}{_MARKS.split(low)[-1][-12:]}{nxt}", f"ws{low[-12:]}{right[:3]}" if size < 4 else "-", f"r{mark}{right[:1]}", f"r2{mark}{right[:2]}", f"r3{mark}{right[:4].lower()}",
        f"d{mark}{'.' in token}{nxt}", f"sq{int(shut)}{int(closed)}{nxt}",
    ]
    if mark == " " or prv in "ct" or nxt in "ct":
        word = re.match(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]*", right)[0]
        out += [f"l1{left[-1:]}", f"l2{left[-2:]}", f"l4{left[-4:]}", f"lr{left[-2:]}|{right[:2]}", f"r4{right[:4]}", f"ab{'.' in word}{'.' in left[-3:]}", f"x{prv}{nxt}{left[-1:] in 'ๆฯ'}"]
    return out


#: Weights that the training starts from: what holds for end marks in general.
START = {
    **{f"m{m}{b}": 2.0 for m in ENDS if m not in ".…" for b in "01"}, "m.1": 0.6, "m.0": -2.5, "m…1": -0.3, "m…0": -0.5, "m 1": 0.8,
    "n.1U": 1.0, "n.1l": -2.5, "n.1d": -0.3, "n.1c": 0.8, "n.1h": 1.0, "n.1a": 1.0, "n.1t": 0.8, "n.1o": 0.8, "n.0U": 1.8, "n.0l": -1.5, "n?1l": -2.5, "n!1l": -2.0, "n?0l": -2.0, "n…1U": 1.5, "n…1l": -2.0, "n.0p": -2.0, "n.1p": -1.0,
    "p.dd0": -3.0, "p.UU1": -1.5, "p 1dt1": -1.0,
    **{f"q{m}0": -6.0 for m in [*ENDS, " "]},
    **{f"x{p}{n}False": -1.6 for p, n in ("dt", "td", "lt", "tl", "Ut", "tU", "dl", "ld", "pt")}, "xttTrue": -1.8,
}


class Tagger:
    """A linear chain over the candidates of a paragraph with the labels inside (0) and boundary (1)."""

    def __init__(self, weights: dict[str, float], chain: list[list[float]], widths: dict[int, float] | None = None):
        self.weights, self.chain, self.widths = weights, chain, widths or {}
        self.memo: dict[tuple, float] = {}

    def score(self, ctx: tuple) -> float:
        """How much better a boundary is than inside."""
        known = self.memo.get(ctx)
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            w = self.weights
            known = self.memo[ctx] = sum(w.get(f, 0.0) for f in features(ctx))
        return known

    def decode(self, scores: list[float]) -> list[int]:
        """The best labels by Viterbi; before the first candidate lies a boundary."""
        c = self.chain
        inside, boundary, back = float("-inf"), 0.0, []
        for s in scores:
            i0, i1 = inside + c[0][0], boundary + c[1][0]
            b0, b1 = inside + c[0][1] + s, boundary + c[1][1] + s
            back.append((int(i1 > i0), int(b1 > b0)))
            inside, boundary = max(i0, i1), max(b0, b1)
        label, out = int(boundary > inside), []
        for step in reversed(back):
            out.append(label)
            label = step[label]
        return out[::-1]

    def units(self, text: str | None) -> list[tuple[int, int]]:
        """(from, to) of the sentence units of a text, in order."""
        found = []
        for kind, start, end in blocks(text, self.widths) if text else ():
            if kind == "unit":
                found.append((start, end))
                continue
            places = candidates(text, start, end)
            labels = self.decode([self.score(context(text, start, end, p)) for p in places])
            for (stop, *_), label in zip(places, labels):
                if label and stop < end:
                    found.append((start, stop))
                    start = stop
            found.append((start, end))
        out = []
        for a, b in found:
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b and any(map(str.isalnum, text[a:b])):
                out.append((a, b))
        return out


# --- training --------------------------------------------------------------------------------------------------


def lists_of(text: str) -> Iterator[list[str]]:
    """The runs of two or more list items that follow each other line by line."""
    run: list[str] = []
    for line in [*_LINES.split(text), ""]:
        m = MARKER.match(line)
        if m and not m[0].lstrip().startswith("#") and line[m.end() :].strip():
            run.append(line[m.end() :].strip())
        else:
            if len(run) > 1:
                yield run
            run = []


def group_of(items: list[str]) -> str:
    """The group of scripts that a list is trained in."""
    joined = "".join(items)
    if joined.isascii():
        return "l"
    kinds = [_script(c) for c in joined]
    for name in "tch":
        if kinds.count(name) * 4 > len(kinds):
            return name
    return "l"


def example(items: list[str], seed: int) -> tuple[str, set[int]]:
    """A paragraph made of list items, and its boundaries. Items that end in a bare word get the full stop that they
    would have in a paragraph; some items meet without a blank."""
    text, ends = "", set()
    for k, item in enumerate(items):
        thai = not item.isascii() and sum(_script(c) == "t" for c in item) * 2 > len(item)
        if thai:
            item = item.rstrip(ENDS)
        elif item[-1].isascii() and (item[-1].isalnum() or item[-1] == ")"):
            item += "."
        text += item
        ends.add(len(text))
        if k + 1 < len(items):
            last, nxt = item[-1:], items[k + 1][:1]
            tight = last in "。！？" or (last in ".?!" and _script(nxt) == "U" and (seed + k) % 12 == 0)
            text += "" if tight else " "
    return text, ends


def _learn(lists: list[list[str]], tagger: Tagger, rounds: int) -> tuple[dict[str, float], list[list[float]]]:
    """What the averaged structured perceptron adds to a tagger's weights (0.0 for features that are seen and kept) and chain.

    Lists that were right in the pass before are looked at again in every fourth pass only.
    """
    ids: dict[str, int] = {}
    memo: dict[tuple, tuple[int, ...]] = {}
    examples = []
    for n, items in enumerate(lists):
        text, ends = example(items, n)
        places = candidates(text, 0, len(text))
        names = []
        for p in places:
            ctx = context(text, 0, len(text), p)
            if ctx not in memo:
                memo[ctx] = tuple(ids.setdefault(f, len(ids)) for f in features(ctx))
            names.append(memo[ctx])
        examples.append((names, [int(p[0] in ends) for p in places]))
    step, size = 1, max(1, len(examples) * rounds)
    weights, total = [tagger.weights.get(f, 0.0) for f in ids], [0.0] * len(ids)
    chain, chain_total = [list(row) for row in tagger.chain], [[0.0, 0.0], [0.0, 0.0]]
    own = Tagger({}, chain)
    wrong = [True] * len(examples)
    for turn in range(rounds):
        for k, (names, gold) in enumerate(examples):
            step += 1
            if not wrong[k] and turn % 4:
                continue
            guess = own.decode([sum([weights[f] for f in fs]) for fs in names])
            wrong[k] = guess != gold
            if wrong[k]:
                share, rest = 0.2, (size - step) / size
                for fs, g, y in zip(names, guess, gold):
                    if g != y:
                        for f in fs:
                            weights[f] += share * (y - g)
                            total[f] += share * (y - g) * rest
                for path, sign in ((gold, share), (guess, -share)):
                    for a, b in zip([1, *path], path):
                        chain[a][b] += sign * 0.1
                        chain_total[a][b] += sign * 0.1 * rest
    return {f: total[k] for f, k in ids.items()}, chain_total


def train(lists: list[list[str]], widths: dict[int, float] | None = None) -> Tagger:
    """A tagger trained on lists from START."""
    added, chain = _learn(lists, Tagger(START, [[0.0, 0.0], [0.0, 0.0]]), ROUNDS)
    return Tagger({**START, **{f: START.get(f, 0.0) + v for f, v in added.items() if v}}, chain, widths)


def train_on(lists: DataFrame, tagger: Tagger, shards: int) -> Tagger:
    """A tagger trained further on all lists (ord, items), each in one of the shards by its hash.

    Every shard starts from the given tagger; a weight changes by the mean over the shards that have its feature, the chain by the mean
    over all. The sums are of whole numbers, so that they don't depend on the order.
    """
    weights, chain, unit = tagger.weights, tagger.chain, float(1 << 30)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["ord", "items"])["items"]
        added, links = _learn([x.split("\n") for x in rows], Tagger(weights, chain), SHARD_ROUNDS)
        flat = [("w", f, round(v * unit)) for f, v in added.items()] + [("c", f"{a}{b}", round(links[a][b] * unit)) for a in (0, 1) for b in (0, 1)]
        return pd.DataFrame(flat, columns=["kind", "name", "added"])

    placed = spread(lists.select(F.pmod("ord", F.lit(shards)).alias("shard"), "ord", "items"), "shard")
    mean = placed.groupBy("shard").applyInPandas(learn, "kind string, name string, added bigint").groupBy("kind", "name").agg(F.sum("added").alias("added"), F.count(F.lit(1)).alias("n"))
    of: dict[str, dict[str, float]] = {"w": {}, "c": {}}
    for r in mean.where("added != 0").collect():
        of[r["kind"]][r["name"]] = r["added"] / unit / r["n"]
    return Tagger({**weights, **{f: weights.get(f, 0.0) + of["w"][f] for f in sorted(of["w"])}}, [[chain[a][b] + of["c"].get(f"{a}{b}", 0.0) for b in (0, 1)] for a in (0, 1)], tagger.widths)


def whole_items(items: list[str], most: int = TRAIN_LIST) -> list[str]:
    """The first items of a list that have at most `most` characters together."""
    sizes = itertools.accumulate(len(x) + 1 for x in items)
    return items[: sum(1 for _ in itertools.takewhile(lambda n: n <= most, sizes))]


def runs_of(items: list[str], most: int = TRAIN_LIST) -> Iterator[list[str]]:
    """A list in runs of whole items that have at most `most` characters together; a longer item is a run of its own."""
    at = 0
    while at < len(items):
        run = whole_items(items[at:], most) or items[at : at + 1]
        yield run
        at += len(run)


def training_data(df: DataFrame, text: str) -> tuple[DataFrame, dict[int, float]]:
    """(lists, widths) that a tagger is trained on, from all texts in one pass.

    lists: (grp, ord, items) of every run of list items, its group of scripts, a hash and its items joined by line ends; repeated
    ones count once. widths: for each class of widths the log odds of wrapped to unwrapped texts among those whose own
    lines leave no doubt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[int]] = {}
        for batch in batches:
            rows = {}
            for body in batch.column(0).to_pylist():
                if not body:
                    continue
                width, odds = wrapping(body, _split(body))
                if abs(odds) >= SURE:
                    seen.setdefault(width // WIDTH_STEP, [0, 0])[odds > 0] += 1
                for items in lists_of(body):
                    for part in runs_of(items):
                        joined = "\n".join(part)
                        if joined not in rows:
                            rows[joined] = (group_of(part), int.from_bytes(blake2b(joined.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True))
            flat = [(group, order, joined, None, None, None) for joined, (group, order) in rows.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], t) for k, t in enumerate(types)], names)
        flat = [(None, None, None, w, no, yes) for w, (no, yes) in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], t) for k, t in enumerate(types)], names)

    types, names = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), ["grp", "ord", "items", "width", "plain", "wrapped"]
    raw = df.select(text).mapInArrow(run, "grp string, ord bigint, items string, width int, plain bigint, wrapped bigint")
    found = cut(raw.groupBy("grp", "ord", "items", "width").agg(F.sum("plain").alias("plain"), F.sum("wrapped").alias("wrapped")))
    widths = {r["width"]: float(np.log((r["wrapped"] + 0.5) / (r["plain"] + 0.5))) for r in found.where("width is not null").collect()}
    return found.where("items is not null").select("grp", "ord", "items"), widths


def fit_tagger(df: DataFrame, text: str, first: int = TRAIN_BLOCKS, shard: int = SHARD_LISTS) -> Tagger:
    """A tagger trained on all lists and line widths of a table; keep it with `save_tagger` and pass it on.

    The training begins with at most `first` lists of each group of scripts, the first by hash, and goes on with all of them, in shards
    of about `shard` lists, where there are more.
    """
    lists, widths = training_data(df, text)
    begin = [r["items"].split("\n") for group in "lcht" for r in lists.where(F.col("grp") == group).select("ord", "items").orderBy("ord", "items").limit(first).collect()]
    tagger = train(begin, widths)
    n, chars = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("items")), F.lit(0))).first()
    return train_on(lists, tagger, max(-(-n // shard), -(-chars // SHARD_CHARS))) if n > len(begin) else tagger


def save_tagger(spark: SparkSession, tagger: Tagger, path: str) -> None:
    """Writes a tagger as a small table."""
    rows = [("w", k, float(v)) for k, v in tagger.weights.items()] + [("c", f"{a}{b}", float(tagger.chain[a][b])) for a in (0, 1) for b in (0, 1)] + [("l", str(k), float(v)) for k, v in tagger.widths.items()]
    spark.createDataFrame(rows, "kind string, name string, value double").coalesce(1).write.mode("overwrite").parquet(path)


def load_tagger(spark: SparkSession, path: str) -> Tagger:
    """The tagger that `save_tagger` wrote."""
    of = {k: {} for k in "wcl"}
    for r in spark.read.parquet(path).collect():
        of[r["kind"]][r["name"]] = r["value"]
    return Tagger(of["w"], [[of["c"][f"{a}{b}"] for b in (0, 1)] for a in (0, 1)], {int(k): v for k, v in of["l"].items()})


def sentence_units(df: DataFrame, key: str, text: str, tagger: Tagger | None = None) -> DataFrame:
    """(key, sent_from, sent_to) of every sentence unit, as code point offsets, end excluded.

    The tagger is trained on the table itself unless one is given. Null, empty and blank texts and texts without a
    letter or digit have no units; repeated rows give their units again. Of the texts only list items are shuffled, for the training;
    the model (some ten thousand weights, more as the words before end marks grow) goes to the workers with the function.
    """
    tagger = tagger or fit_tagger(df, text)
    weights, chain, widths = tagger.weights, tagger.chain, tagger.widths
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger(weights, chain, widths)
        for batch in batches:
            index, spans = [], []
            for n, body in enumerate(batch.column(1).to_pylist()):
                found = own.units(body)
                index += [n] * len(found)
                spans += found
            table = np.array(spans, dtype=np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), pa.array(table[:, 0]), pa.array(table[:, 1])], [key, "sent_from", "sent_to"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, sent_from int, sent_to int")
