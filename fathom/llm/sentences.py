"""Sentence boundaries across languages and scripts.

Method. A first pass masks what is no prose (fenced code, the markers of headings, lists and quoted blocks) and
turns every hard boundary (blank line, heading, list item, change of quoting) into a break, so positions stay
those of the text. The rest is blocks, and each is read through lattices.

*Spaced scripts*: a terminator lattice. Its nodes are the runs of terminators, an edge from one to a later one is a
sentence. Cutting and passing over a node have costs by what stands before it (abbreviation, initial, number, ordinal),
at it (ellipsis, closing marks) and behind it (a word that goes on, a word or name that opens), and a cut within
brackets or quotes that opened in the same sentence and close later costs more, which depends on where the sentence
began. The cheapest path through the block gives the sentences. Open paths that another one beats whatever follows are
dropped, so the time is proportional to the text.

*Spaceless scripts*: word lattices. In Chinese and Japanese the text on either side of a gap (a mark with closing quotes)
is segmented by the cheapest path over a dictionary: particles and openings listed below, and the words of these scripts
in a public tokenizer's vocabulary. A particle that carries on behind the gap makes a cut dear, an opening word behind
it or a final particle before it makes passing over dear. Thai is read without a lattice: by definition every space
between two Thai letters ends a sentence, whatever the words around it.

Defined cases: null texts and rows without id give nothing; empty and blank texts give nothing; a block without
letter or digit is no sentence; an unclosed fence reaches to the end; very long texts are read whole, in time
proportional to their length. Offsets count code points from 0.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.packing import default_vocabulary

_FENCE = re.compile(r"[ \t>]*(`{3,}|~{3,})")
_QUOTE = re.compile(r"[ \t]*(?:>[ \t]?)+")
_MARKER = re.compile(r"[ \t]*(?:(#{1,6})(?=[ \t]|$)|([-*+•·])(?=[ \t])|(\d{1,9})[.)](?=[ \t]))[ \t]*(?:\[[ xX]\][ \t]+)?")
_RULE = re.compile(r"[ \t]*(?:(?:[-*_=][ \t]*){3,}|[|: -]*-{3,}[|: -]*)$")
_BREAK = "\x00"

_TERMINATORS = re.compile("[.!?。！？｡．؟۔।॥‼⁇⁈⁉…]+")
_SPACELESS = frozenset("。！？｡．۔।॥")
_CLOSERS = "\"'”’“»›)]）】」』〉》`*_"
_OPENERS = "\"'“„«‹‘‚(\\[（「『【〈《¿¡`*_"
_BEHIND = re.compile(rf"[ \t\n]*([{_OPENERS}]*)[ \t]?([\w$][\w.$()/-]*|.)?", re.S)
_BEFORE = re.compile(r"[^\s\"'“”„«»(\[（¿¡`*,;:]*$")
_TRIM = ".,;:!?)»”\"'"
_THAI = "ก-ฺเ-๎"
_GAPS = re.compile(rf"(?<=[{_THAI}])[ \t]+(?=[{_THAI}])")
_INNER_DOTS = re.compile(r"(?:[^\W\d_]{1,3}\.)+[^\W\d_]{1,3}$")
_WORD = re.compile(r"\w")
#: Unicode spaces, one for one, so that positions stay.
_SPACES = dict.fromkeys([0, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000], " ")

# Abbreviations of the languages treated. Those of the first list never end a sentence.
_NEVER = frozenset(
    """e.g i.e cf vs viz approx ca dr mr mrs ms prof st m mm mme mlle me sr sra srta dra ing lic gen col sgt rev hon
    z z.b d d.h u u.a o o.ä s.o s.u bzw evtl ggf vgl inkl exkl usf. sog bspw zzgl abzgl hr fr frl
    p p.ex p.ej ex env c.-à-d aprox ej
    т т.е напр см ср им проф акад гр гос тов ул
    د أ م डॉ श्री प्रो""".split()
)
# These stand before a number or a name; before a capital letter they may close a sentence.
_BEFORE_NUMBER = frozenset(
    """fig figs sec secs chap ch no nos nr p pp pg vol ed eds art eq para ref tab ver rev
    abb abs kap s seite bd nr tab anm art ziff
    chap fig pág págs núm cap art sec n° nº
    рис стр гл п пп табл разд т с в""".split()
)
# These may end one: they do before a word that opens.
_MAYBE = frozenset("etc usw u.s.w jr sr co inc ltd corp dept p.m a.m am pm др пр г гг руб тыс млн млрд д п al".split())
_MONTHS = frozenset(
    """januar jänner februar märz april mai juni juli august september oktober november dezember
    jan feb mär apr jun jul aug sep sept okt nov dez""".split()
)
# Closed classes of spaceless scripts. Particles that carry a quotation on, words that open a sentence,
# particles that end one.
_PARTICLES = """と って という といった との とか として とは とも は が を に で も の へ や から まで より など だ です である だった でした
    的 地 得 之 等 而已 之类 似的""".split()
_OPENINGS = """しかし また そして ただし さらに なお つまり たとえば 例えば もし そのため したがって それで では この その これ それ
    如果 当 但是 因此 所以 虽然 然而 而且 因为 为了 不过 另外 同时 首先 其次 最后 这 那 该 每 请 见 把 为什么""".split()
# Common words that begin as a particle does.
_ALIKE = """とても ところ ところで とき とりあえず もっと もちろん もう まだ まず だから だが ですから でも なので なぜ のち かなり からだ へや はじめ にわか
    得到 得出 得知 地方 地址 地图 之前 之后 之间 等待 等于 等级 的确""".split()
_FINALS = "か ね よ な ぞ わ さ 吗 呢 吧 了 啊 啦 呀 嘛".split()
_ON = frozenset(",;:，、；：—–-→=+/&%…·")


_MERIDIEM = frozenset(("a.m", "p.m"))


def _composed(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


_SCRIPTS = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]+")
_WORD_FORM = re.compile("[\u3040-\u309f]+|[\u30a0-\u30ff]+|[\u3400-\u9fff]+[\u3040-\u309f]*")


class WordLattice:
    """Cheapest segmentation of Chinese or Japanese text: listed words cost 1, words of the vocabulary 1.5, other characters 2."""

    def __init__(self, vocabulary: str | None):
        self.words: dict[str, tuple[float, str]] = {}
        if vocabulary:
            with open(vocabulary, "rb") as f:
                for line in f:
                    word = base64.b64decode(line.split(b" ")[0]).decode("utf-8", "replace").strip()
                    if len(word) > 1 and _WORD_FORM.fullmatch(word):
                        self.words[word] = 1.5, "word"
        for kind, words in (("final", _FINALS), ("particle", _PARTICLES), ("opening", _OPENINGS), ("word", _ALIKE)):
            self.words |= dict.fromkeys(words, (1.0, kind))
        self.longest = max(map(len, self.words))

    def segment(self, text: str) -> list[tuple[str, str]]:
        """(word, class) of the cheapest path; ties go to the longer first word."""
        n = len(text)
        cost, step, kind = [0.0] * (n + 1), [1] * n, ["other"] * n
        for i in range(n - 1, -1, -1):
            cost[i] = 2 + cost[i + 1]
            for size in range(1, min(self.longest, n - i) + 1):
                found = self.words.get(text[i : i + size])
                if found and found[0] + cost[i + size] <= cost[i]:
                    cost[i], step[i], kind[i] = found[0] + cost[i + size], size, found[1]
        out, i = [], 0
        while i < n:
            out.append((text[i : i + step[i]], kind[i]))
            i += step[i]
        return out

    def around(self, block: str, before: int, behind: int) -> tuple[str, str]:
        """The classes of the last word of the run of script that ends at ``before`` and of the first one of that at ``behind``."""
        lo = before
        while lo > 0 and _SCRIPTS.match(block[lo - 1]):
            lo -= 1
        run = _SCRIPTS.match(block, behind)
        left = self.segment(block[lo:before]) if lo < before else []
        right = self.segment(run.group()) if run else []
        return left[-1][1] if left else "", right[0][1] if right else ""


def word_lattice(vocabulary: str | None) -> WordLattice:
    """The lattice of a vocabulary file, built once in each worker process and only when a text needs it."""
    cache = sys.__dict__.setdefault("_fathom_lattices", {})
    if vocabulary not in cache:
        cache[vocabulary] = WordLattice(vocabulary)
    return cache[vocabulary]


def mask(text: str) -> str:
    """``text`` with everything that is no prose blanked and every hard boundary replaced by a break character."""
    out: list[str] = []
    fence = ""
    kind, quoted = "", False  # of the open block: "" none, "p" paragraph, "l" list item
    for line in (text.replace(_BREAK, " ") if text.isascii() else text.translate(_SPACES)).split("\n"):
        bare = line.rstrip("\r")
        f = _FENCE.match(bare)
        if fence:
            if f and f.group(1).startswith(fence) and not bare[f.end() :].strip():
                fence = ""
            out.append(_BREAK + " " * len(line))
            kind = ""
            continue
        if f:
            fence = f.group(1)
            out.append(_BREAK + " " * len(line))
            kind = ""
            continue
        q = _QUOTE.match(bare)
        skip = q.end() if q else 0
        rest = bare[skip:]
        if not rest.strip() or _RULE.match(rest):
            out.append(_BREAK + " " * len(line))
            kind = ""
            continue
        m = _MARKER.match(rest)
        if m and m.group(3) and kind == "p" and bool(q) == quoted and m.group(3) != "1":
            m = None  # a number that the line's wrapping brought to the front
        if m:
            heading = bool(m.group(1))
            skip += m.end()
            lead = _BREAK
            after = "" if heading else "l"
        else:
            lead = "\n" if kind and bool(q) == quoted else _BREAK
            after = kind if lead == "\n" else "p"
        out.append(lead + " " * skip + line[skip:])
        kind, quoted = after, bool(q)
    return "".join(out)[1:]


def _plain(word: str) -> bool:
    """A word in lower case that is no identifier, file name or call."""
    w = word.strip(_TRIM)
    return bool(w) and w[0].islower() and w == w.lower() and not any(c in w for c in "._$()/") and not any(c.isdigit() for c in w)


#: Costs in the lattices: against the evidence, against an abbreviation, within brackets or quotes, never.
AGAINST, ABBREVIATED, WITHIN, NEVER = 4.0, 6.0, 8.0, 1e9


def _weigh(block: str, run: str, at: int, end: int, vocabulary: str | None) -> tuple[int, float, float, bool] | None:
    """(place of the cut, cost of cutting, cost of passing over, whether brackets count) of the terminators ``run``
    at ``at``, or None if no sentence can end there."""
    marks = run.strip(".…")
    if not marks and (len(run) > 1 or run == "…"):
        return None  # ellipsis
    n = len(block)
    close = end
    while close < n and block[close] in _CLOSERS:
        if block[close] in "“‘" and close + 1 < n and block[close + 1].isalnum():
            break  # it opens
        close += 1
    closed = close > end
    if block.startswith((" »", " »", " »", " ›"), close) and not block[close + 2 : close + 3].isalnum():
        close, closed = close + 2, True
    if close >= n:
        return close, 0.0, AGAINST, False
    nxt = block[close]
    space = nxt in " \t\n  　"
    wide = run[-1] in _SPACELESS or ord(nxt) >= 0x2E80
    if not space and not wide:
        return None
    m = _BEHIND.match(block, close)
    opener, word = m.group(1), m.group(2) or ""
    if not word:
        return close, 0.0, AGAINST, False
    cut, keep = 0.0, AGAINST
    if not opener and word[0] in _ON:
        if closed or wide or word[0] != "-":
            return close, ABBREVIATED, 0.0, False
        return close, 0.0, AGAINST, False
    if closed and not space and _SCRIPTS.match(nxt):
        final, behind = word_lattice(vocabulary).around(block, at, close)
        if behind == "particle":
            return close, AGAINST, 0.0, False
        keep += (behind == "opening") + (final == "final")
    if _plain(word) and (not opener or set(opener) <= {"*", "_"}):
        return close, ABBREVIATED, 0.0, False
    if run == "." and not closed:
        before = _composed(_BEFORE.search(block, max(0, at - 24), at).group().lower())
        if before:
            if before in _NEVER or (len(before) == 1 and before.isalpha() and block[at - 1].isupper()):
                return close, ABBREVIATED, 0.0, False
            if before in _MERIDIEM and block[at - 1].isupper():
                return close, ABBREVIATED, 0.0, False  # all is in capitals, so a capital opens nothing
            if before in _MAYBE:
                return (close, 0.0, AGAINST, False) if not _plain(word) and not word[0].isdigit() else (close, AGAINST, 0.0, False)
            if before in _BEFORE_NUMBER:
                return (close, AGAINST, 0.0, False) if word[0].isdigit() else (close, 0.0, AGAINST, False)
            if _INNER_DOTS.match(before) and not before[0].isdigit():
                return close, ABBREVIATED, 0.0, False
            if before.isdigit() and len(before) <= 2 and word.strip(_TRIM).lower() in _MONTHS:
                return close, ABBREVIATED, 0.0, False  # ordinal
    return close, cut, keep, not closed


_PAIRS = (("(", ")"), ("（", "）"), ("「", "」"), ("『", "』"), ("“", "”"), ("„", "“"), ("«", "»"), ("[", "]"))
_MARKS = re.compile("[" + re.escape("".join(sorted({c for p in _PAIRS for c in p}))) + '"]')


class _Enclosures:
    """Where brackets and quotes of a block open and close."""

    def __init__(self, block: str):
        self.block = block
        self.at: dict[str, list[int]] = {}
        for m in _MARKS.finditer(block):
            self.at.setdefault(m.group(), []).append(m.start())
        self.quotes = self.at.get('"', [])

    def _lead(self, i: int) -> int:
        """The last character before ``i`` that is no space."""
        while i > 0 and self.block[i - 1].isspace():
            i -= 1
        return i - 1

    def within(self, at: int) -> tuple[int, int]:
        """Up to which beginnings of a sentence ``at`` stands within brackets, and, if an odd number of straight quotes
        has passed since the beginning, within those; -1 for none."""
        brackets = quotes = -1
        for a, b in _PAIRS:
            opened = self.at.get(a)
            if not opened or not (k := bisect_left(opened, at)):
                continue
            i, closing = opened[k - 1], self.at.get(b, [])
            j = bisect_left(closing, i + 1)
            if j < len(closing) and closing[j] >= at:  # the first closing one comes later
                brackets = max(brackets, self._lead(i))
        k = bisect_left(self.quotes, at)
        if k and k < len(self.quotes):
            quotes = self._lead(self.quotes[k - 1])
        return brackets, quotes

    def parity(self, at: int) -> int:
        return bisect_left(self.quotes, at) % 2


def terminator_path(block: str, vocabulary: str | None = None) -> list[int]:
    """The cuts of the cheapest path through the terminator lattice of a block.

    An open path is (beginning of its sentence, its parity of straight quotes, cost, cuts). A later beginning is within
    brackets wherever an earlier one is not more seldom, so an open path that costs no less than one of a later
    beginning and the same parity is dropped.
    """
    nodes = [w for m in _TERMINATORS.finditer(block) if (w := (m.start(), _weigh(block, m.group(), m.start(), m.end(), vocabulary)))[1]]
    if not nodes:
        return []
    marks = _Enclosures(block) if any(w[3] for _, w in nodes) and _MARKS.search(block) else None
    paths: list[tuple[int, int, float, tuple | None]] = [(0, 0, 0.0, None)]
    for at, (close, cut, keep, counts) in nodes:
        brackets, quotes = marks.within(at) if marks and counts else (-1, -1)
        parity = marks.parity(at) if marks and quotes >= 0 else 0
        best = NEVER
        after = None
        kept = []
        for start, own, cost, cuts in paths:
            inside = start <= brackets or (start <= quotes and own != parity)
            through = cost + (WITHIN if inside else cut)
            if through < best:
                best, after = through, cuts
            kept.append((start, own, cost + (0.0 if inside else keep), cuts))
        fresh = (close, marks.parity(close) if marks else 0, best, (close, after))
        paths = [fresh]
        least = {fresh[1]: best}
        for path in kept:
            if path[2] < least.get(path[1], NEVER):
                least[path[1]] = path[2]
                paths.append(path)
    _, _, _, cuts = min(paths, key=lambda p: p[2])
    out = []
    while cuts:
        out.append(cuts[0])
        cuts = cuts[1]
    return out[::-1]


def thai_gaps(block: str) -> list[int]:
    """The spaces between two Thai letters; each ends a sentence."""
    return [m.start() for m in _GAPS.finditer(block)]


def sentence_spans(text: str, vocabulary: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence of ``text``."""
    spans: list[tuple[int, int]] = []
    offset = 0
    for block in mask(text).split(_BREAK):
        if _WORD.search(block):
            cuts = [0, *terminator_path(block, vocabulary)]
            if gaps := thai_gaps(block) if not block.isascii() else []:
                cuts = sorted({*cuts, *gaps})
            for a, b in zip(cuts, [*cuts[1:], len(block)]):
                part = block[a:b]
                lead = len(part) - len(part.lstrip())
                body = part.strip()
                if not body:
                    continue
                if _WORD.search(body):
                    spans.append((offset + a + lead, offset + a + lead + len(body)))
                elif spans and a:
                    spans[-1] = (spans[-1][0], offset + a + lead + len(body))
        offset += len(block) + 1
    return spans


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, position, start_char, end_char[, sentence]) of every sentence, whatever the language; no shuffle.

    ``vocabulary`` is the rank file of a public tokenizer, from which the word lattices take their words.
    """
    path = vocabulary or default_vocabulary()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, position, start, end, body = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = sentence_spans(text, path)
                row += [i] * len(found)
                position += range(len(found))
                start += [a for a, _ in found]
                end += [b for _, b in found]
                if with_text:
                    body += [text[a:b] for a, b in found]
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (position, start, end))]
            if with_text:
                columns.append(pa.array(body, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "position", "start_char", "end_char", "sentence"][: len(columns)])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, position long, start_char long, end_char long" + (", sentence string" if with_text else ""))
