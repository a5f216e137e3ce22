"""Sentence boundaries across languages and scripts (problem 8).

Lines of only white space, lines with a list mark and blanks between Thai
characters bound sentences by themselves. Elsewhere every end mark outside
quotations and brackets is a candidate, and so is the end of a quotation or
bracket that holds one. A maximum-entropy classifier decides candidates by the
tokens beside the mark, their case, length, digits and script, the mark and the
closing quotes.

The classifier is trained on reliable boundaries only, from a bounded sample of
texts (``sample_texts`` of at most ``SAMPLE_LENGTH`` code points each, those of
the smallest key hash) and a few ``SEEDS``: yes for an end mark that a blank line
follows, looked at as if the next paragraph went on in the line; no where a
lower-case word follows, where a word that goes before others or an initial
stands before a name or number, and where a script has an end mark of its own.
Everything else is applied to every text alike.

Which words go before others is learned from the sample: short words that hardly
ever stand without their period and never end a paragraph (``Usage``). Words of
``ABBREVIATIONS`` count as seen so, for corpora too small to tell.

End marks are those of Unicode's Sentence_Terminal property, the ellipsis, the
Greek question mark and the Tibetan shad.

Defined results: null, empty and blank texts have no sentence; positions count
code points, the end is exclusive, outer white space belongs to no sentence; a
quotation that isn't closed within its paragraph protects nothing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 15
SAMPLE_LENGTH = 20_000

#: Abbreviations that go before a name, a number or a further word, not at an end.
ABBREVIATIONS = frozenset(
    """
    dr mr mrs ms prof st rev sgt capt col gen fig figs no nos vol pp p ch sec art eq approx ca vs cf e.g i.e
    hr fr fa nr abb tab abschn vgl bzw lt inkl evtl ggf geb str zb z.b u.a d.h s
    mme mlle m chap env p.ex fig art n
    sr sra srta dra pág págs cap núm aprox ej p.ej
    инж проф рис табл стр см ок гл тов г-н ул им
    डॉ श्री सं पृ कि.ग्रा
    د
    """.split()
)
#: Month names that may follow an ordinal day.
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember jan feb apr jun jul aug sep sept okt nov dez".split())
PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", '"': '"', "‹": "›"}
OPENERS = regex.compile("[" + regex.escape("".join(PAIRS)) + "]")
LIST_LINE = regex.compile(r"[ \t]*(?:- |\p{Nd}+\) )")
#: End marks that scripts with spaces share, and those of Chinese and Japanese.
SPACED, WIDE = ".!?…؟\u037e", "。！？｡．﹒﹖﹗"
END = regex.compile(r"[\p{Sentence_Terminal}…\u037e།༎]+")
OWN_MARK = regex.compile(r"[\p{Sentence_Terminal}།༎--[" + SPACED + WIDE + r"]]", regex.V1)
CLOSERS = "”’“»」』）)]】》\"'›"
BREAKS_TOKEN = frozenset("“”„«»「」『』（）()[]\"")
THAI = regex.compile(r"\p{Thai}")
#: Words that no period follows.
WORD_ALONE = regex.compile(r"(?<![\p{L}\p{N}.&-])[\p{L}\p{M}]+(?:[.&-][\p{L}\p{M}]+)*+(?![.\p{L}\p{M}])")
THAI_BLANK = regex.compile(r"(?<=\p{Thai})[^\S\n]+(?=\p{Thai})")
SCRIPTS = (
    ("latin", regex.compile(r"\p{Latin}")),
    ("cyrillic", regex.compile(r"\p{Cyrillic}")),
    ("greek", regex.compile(r"\p{Greek}")),
    ("thai", regex.compile(r"\p{Thai}")),
    ("indic", regex.compile(r"[\p{Devanagari}\p{Bengali}\p{Gujarati}\p{Tamil}\p{Telugu}]")),
    ("arabic", regex.compile(r"[\p{Arabic}\p{Hebrew}]")),
    ("cjk", regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")),
)


@lru_cache(maxsize=100_000)
def letter_script(ch: str) -> str:
    return next((name for name, p in SCRIPTS if p.match(ch)), "none")


@lru_cache(maxsize=100_000)
def script(token: str) -> str:
    for ch in reversed(token):
        if ch.isalpha() or not ch.isascii():
            found = letter_script(ch)
            if found != "none":
                return found
    return "none"


@lru_cache(maxsize=100_000)
def ends_sentences(ch: str) -> bool:
    return END.match(ch) is not None


@lru_cache(maxsize=10_000)
def own_mark(ch: str) -> bool:
    """An end mark that only some scripts use, and for nothing else."""
    return OWN_MARK.match(ch) is not None


@lru_cache(maxsize=100_000)
def shape(token: str) -> str:
    """Case class of the token that follows a mark."""
    if not token:
        return "end"
    ch = token[0]
    if ch.isdigit():
        return "digit"
    if ch.isalpha():
        if ch.islower():
            return "lower" if token.islower() or not token[1:2].isupper() else "upper"
        return "upper" if ch.isupper() or ch.istitle() else "uncased"
    if ch in "“„«「『\"'‹»":
        return "quote:" + shape(token[1:].lstrip()[:12])
    if ch in "([（【":
        return "bracket"
    return "open" if ch in "¿¡" else "other" if not ch.isspace() else "end"


def partner_map(text: str, start: int, end: int, opens: str) -> dict[int, int]:
    """Closing place of each mark ``opens`` that is closed, in one pass; marks of one kind nest."""
    closes = PAIRS[opens]
    found: dict[int, int] = {}
    if opens in closes:
        places = [m.start() for m in regex.finditer(regex.escape(opens), text, pos=start, endpos=end)]
        return dict(zip(places, places[1:]))
    stack: list[int] = []
    for m in regex.finditer(f"[{regex.escape(opens + closes)}]", text, pos=start, endpos=end):
        if m.group() == opens:
            stack.append(m.start())
        elif stack:
            found[stack.pop()] = m.start()
    return found


def protected(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost quotations and brackets of a paragraph, half open."""
    spans, last = [], start
    maps: dict[str, dict[int, int]] = {}
    for m in OPENERS.finditer(text, start, end):
        at, ch = m.start(), m.group()
        if at < last:
            continue
        if ch not in maps:
            maps[ch] = partner_map(text, start, end, ch)
        to = maps[ch].get(at, -1)
        if to >= 0:
            spans.append((at, to + 1))
            last = to + 1
    return spans


def candidates(text: str, start: int, end: int, spans: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str, bool]]:
    """``(mark, stop, mark's characters, closes)`` of a paragraph; ``stop`` is where a sentence would end."""
    found, spans = [], protected(text, start, end) if spans is None else spans
    for a, b in spans:
        last = b - 2
        while last > a and text[last].isspace():
            last -= 1
        if last > a and ends_sentences(text[last]) and not ends_sentences(text[b : b + 1] or "x"):
            mark = last
            while mark > a + 1 and ends_sentences(text[mark - 1]):
                mark -= 1
            found.append((mark, b, text[mark : last + 1], True))
    k = 0
    for m in END.finditer(text, start, end):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k < len(spans) and spans[k][0] < m.start():
            continue
        stop = m.end()
        while stop < end and text[stop] in CLOSERS and not (k < len(spans) and spans[k][0] == stop):
            stop += 1
        if stop < end and not text[stop].isspace():
            last = m.group()[-1]
            if not (last in WIDE or last in "…؟" or own_mark(last) or letter_script(text[stop]) == "cjk"):
                continue
        found.append((m.start(), stop, m.group(), stop > m.end()))
    found.sort(key=lambda c: c[1])
    return found


@lru_cache(maxsize=100_000)
def slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % SLOTS


def neighbours(text: str, mark: int, stop: int, end: int) -> tuple[str, str, bool]:
    """Token before the mark, token after it, whether white space lies between."""
    low, last = max(0, mark - 60), mark
    while last > low and text[last - 1].isspace():
        last -= 1
    first = last
    while first > low and not text[first - 1].isspace() and text[first - 1] not in BREAKS_TOKEN:
        first -= 1
    rest = text[stop : min(end, stop + 60)]
    after = rest.split(None, 1)
    return text[first:last], after[0] if after else "", not rest or rest[0].isspace()


def is_day(before: str, after: str) -> bool:
    """An ordinal day before a month, as in "3. Mai"."""
    return before.isdecimal() and 1 <= int(before) <= 31 and after.casefold().rstrip(".,;:!?)") in MONTHS


@lru_cache(maxsize=100_000)
def word_of(before: str) -> tuple[str, int, bool, bool, str]:
    """The token as a word, its letters, whether it is an initial, whether it has digits, its script."""
    word = before.casefold().strip("-–—,;:")
    letters = word.replace(".", "")
    initial = len(letters) == 1 and letters.isalpha() and before[-1:].isupper()
    return word, len(letters), initial, any(ch.isdigit() for ch in word), script(before)


class Usage:
    """How words stand with a period in a sample of texts."""

    def __init__(self, texts: Sequence[str] = (), least: int = 4, share: float = 0.95, letters: int = 5) -> None:
        dotted: dict[str, list] = {}
        starters: set[str] = set()  # words that begin paragraphs
        for text in texts:
            for s, e, listed in paragraphs(text):
                if listed:
                    continue
                starters.add(text[s : s + 60].split(None, 1)[0].casefold())
                for mark, stop, chars, closes in candidates(text, s, e):
                    if chars == "." and not closes:
                        before, after, _ = neighbours(text, mark, stop, e)
                        word = word_of(before)[0]
                        if 0 < len(word.replace(".", "")) <= letters and not any(ch.isdigit() for ch in word):
                            seen = dotted.setdefault(word, [0, Counter()])
                            seen[0] += stop >= e
                            seen[1][after if shape(after) == "upper" else ""] += 1
        plain = Counter(token for text in texts for token in WORD_ALONE.findall(text))
        lower = Counter()
        for token, n in plain.items():
            lower[token.casefold()] += n
        common = {w.casefold() for w in plain if w.islower()}

        def before(word: str, at_end: int, after: Counter) -> bool:
            n = after.total()
            # what follows as at the beginning of a sentence: a word that begins paragraphs or stands in lower case elsewhere
            begins = sum(k for w, k in after.items() if w and (w.casefold() in starters or w.casefold().strip(".,;:!?") in common))
            return not at_end and n >= least and n >= share * (n + lower[word]) and begins <= n / 2

        self.before = frozenset(w for w, (at_end, after) in dotted.items() if before(w, at_end, after))
    def goes_before(self, word: str) -> bool:
        return word in ABBREVIATIONS or word in self.before


def mark_kind(chars: str) -> str:
    last = chars[-1]
    return "dots" if last == "…" or chars.endswith("..") else last if last in SPACED else "wide" if last in WIDE else "danda"


def feature_groups(before: str, after: str, spaced: bool, chars: str, closes: bool, usage: Usage) -> tuple[tuple[tuple, Callable[[], tuple[str, ...]]], ...]:
    """The features in groups, each with the key that determines it."""
    word, length, initial, has_digit, own = word_of(before)
    nxt, kind, size = shape(after[:60]), mark_kind(chars), min(length, 7)
    first = "0" if after[:1].isdigit() else after.casefold()[:12]
    beside = script(after[:3])

    def of_word() -> tuple[str, ...]:
        w, short = "0" if has_digit else word, usage.goes_before(word)
        return (
            "bias", f"kind={kind}", f"next={nxt}", f"kind,next={kind},{nxt}", f"word={w},{kind}", f"word,next={w},{nxt},{kind}", f"short,next={short},{nxt},{kind}",
            f"initial,next={initial},{nxt},{kind}", f"dotted={'.' in word},{nxt}", f"size={size},{kind}", f"size,next={size},{nxt},{kind}", f"script={own},{kind}", f"digit={has_digit},{nxt},{kind}",
        )

    return (
        ((before, kind, nxt), of_word),
        ((first,), lambda: (f"after={first}",)),
        ((closes, nxt, spaced, own), lambda: (f"closes,next={closes},{nxt},{spaced},{own}",)),
        ((own, beside, kind, spaced), lambda: (f"script,next={own},{beside},{kind},{spaced}",)),
        ((is_day(before, after),), lambda: (f"day={is_day(before, after)}",)),
    )


def features(before: str, after: str, spaced: bool, chars: str, closes: bool, usage: Usage = None) -> list[int]:
    return [slot(f) for _, names in feature_groups(before, after, spaced, chars, closes, usage or NO_USAGE) for f in names()]


class Classifier:
    """Weights of the features, and the words that go before others; sums of feature groups are kept."""

    KEPT = 200_000

    def __init__(self, weights: np.ndarray, usage: Usage) -> None:
        self.weights, self.usage = weights, usage
        self.sums: tuple[dict, ...] = tuple({} for _ in range(5))

    def ends(self, before: str, after: str, spaced: bool, chars: str, closes: bool) -> bool:
        total = 0.0
        for known, (key, names) in zip(self.sums, feature_groups(before, after, spaced, chars, closes, self.usage)):
            value = known.get(key)
            if value is None:
                if len(known) >= self.KEPT:
                    known.clear()
                value = known[key] = float(sum(self.weights[slot(f)] for f in names()))
            total += value
        return total > 0


def paragraphs(text: str) -> Iterator[tuple[int, int, bool]]:
    """``(start, end, is_list_line)`` without outer white space."""
    at, start, last = 0, None, 0
    for line in text.split("\n"):
        end = at + len(line)
        blank, marked = not line.strip(), LIST_LINE.match(line) is not None
        if (blank or marked) and start is not None:
            yield start, last, False
            start = None
        if marked and not blank:
            yield at + len(line) - len(line.lstrip()), at + len(line.rstrip()), True
        elif not blank:
            if start is None:
                start = at + len(line) - len(line.lstrip())
            last = at + len(line.rstrip())
        at = end + 1
    if start is not None:
        yield start, last, False


NO_USAGE = Usage()


def reliable(text: str, usage: Usage = NO_USAGE) -> Iterator[tuple[list[int], int]]:
    """Features and labels of the boundaries that are certain."""
    parts = [(s, e) for s, e, listed in paragraphs(text) if not listed]
    for i, (s, e) in enumerate(parts):
        follow = text[parts[i + 1][0] : parts[i + 1][0] + 60].split(None, 1)[0] if i + 1 < len(parts) else ""
        for mark, stop, chars, closes in candidates(text, s, e):
            before, after, spaced = neighbours(text, mark, stop, e)
            own, nxt = script(before), shape(after)
            if stop >= e:
                if follow and script(follow) == own or own == "none":
                    yield features(before, follow, True, chars, closes, usage), 1
                continue
            last = chars[-1]
            if (last in "?!؟\u037e" or last in WIDE or own_mark(last)) and not closes:
                yield features(before, after, spaced, chars, closes, usage), int(nxt != "lower")
            elif nxt == "lower" or own in ("thai", "indic") and last == ".":
                yield features(before, after, spaced, chars, closes, usage), 0
            elif closes and nxt == "uncased" or last == "…" and nxt == "uncased" and not spaced:
                yield features(before, after, spaced, chars, closes, usage), 0
            elif chars == "." and not closes:
                word, length, initial, _, _ = word_of(before)
                if is_day(before, after) or usage.goes_before(before.casefold()) or initial:
                    yield features(before, after, spaced, chars, closes, usage), 0


def train(texts: list[str], rounds: int = 200, rate: float = 0.5, decay: float = 1e-4) -> Classifier:
    """The classifier; one without weights ends nothing."""
    rows, labels = [], []
    usage = Usage(texts)
    for t in texts:
        for f, y in reliable(t, usage):
            rows.append(f)
            labels.append(y)
    weights = np.zeros(SLOTS)
    if not rows:
        return Classifier(weights, usage)
    x, y = np.array(rows), np.array(labels, float)
    share = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))  # both classes weigh the same
    scale = np.full(SLOTS, 1e-8)
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-weights[x].sum(axis=1))) - y) * share
        step = np.bincount(x.ravel(), np.repeat(error, x.shape[1]), SLOTS) + decay * weights / len(y)
        scale += step * step
        weights -= rate * step / np.sqrt(scale)
    return Classifier(weights, usage)


def split(text: str, classifier: Classifier) -> list[tuple[int, int]]:
    """Start and end of every sentence of one text, in order."""
    out = []
    thai, quoted = THAI.search(text) is not None, OPENERS.search(text) is not None
    for s, e, listed in paragraphs(text):
        if listed:
            out.append((s, e))
            continue
        spans = protected(text, s, e) if quoted else []
        stops = []
        if thai:
            k = 0
            for m in THAI_BLANK.finditer(text, s, e):
                while k < len(spans) and spans[k][1] <= m.start():
                    k += 1
                if not (k < len(spans) and spans[k][0] < m.start() < spans[k][1]):
                    stops.append(m.start())
        for mark, stop, chars, closes in candidates(text, s, e, spans):
            if stop < e and classifier.ends(*neighbours(text, mark, stop, e), chars, closes):
                stops.append(stop)
        at = s
        for stop in [*(sorted(set(stops)) if thai else dict.fromkeys(stops)), e]:
            a, b = at, stop
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
            at = stop
    return out


#: Texts that every training gets besides its sample, so that few texts still teach each kind of boundary.
SEEDS = (
    "The pump was cold. The crew left.\n\nDr. Miller came at 4 p.m. The load was approx. 3 kN, i.e. less. See Fig. 3 for it.\n\nWedges, shims, etc.\n\nIt ended at 5 p.m.\n\nPart No. 5 broke! Why did it fail? Nobody knew.\n\nWait... did it move? It stopped… Then it went on.",
    "They met Mr. Hall and Mrs. Grey of Hall & Co. in St. Ives. The note says “do not open.” in ink. The lid is shut.\n\n(The seal was not tested.) It held.\n\nLots 3 ff. were kept. E. Stone signed.",
    "Das Teil wiegt ca. 5 kg. Am 3. Mai kam Dr. Kern, vgl. Abb. 3 auf S. 9.\n\nEs ist z. B. Stahl u. a. gelagert. Die Fa. Holm lieferte Keile usw. Die Welle steht still.\n\nWarum bricht sie? Niemand weiß es. Um 5.30 Uhr war Ende.",
    "La pièce pèse env. 5 kg, p. ex. au chap. 3. M. Durand a dit : « Arrêtez. » à tous. Le lot est prêt.\n\nPourquoi ? Rien ne bouge. Voir fig. 4.",
    "El Sr. Mora dijo: «Pare.» y se fue. La pieza pesa aprox. 5 kg. Véase la pág. 3.\n\n¿Por qué falla? ¡Nunca pare! El lote está listo.",
    "Деталь весит ок. 5 кг, т. е. мало. Инж. Белов сказал: «Стоп.» и ушёл. См. рис. 3.\n\nВзяли клинья и т. д. Смена ушла.\n\nПочему? Не ясно.",
    "检验完成。他说：“停机。”然后离开。停机！为什么？数值很高……但没有报警。\n\n更换后正常。「先冷却。」这一条写在门上。",
    "焼なましの後に割れた。「停止。」と言った。値は高かった…が、警報は出なかった。\n\nなぜ止まったのか？交換した。",
    'यह ठीक है। डॉ. राम ने कहा, "रुको।" और चले गए। चित्र सं. 8 देखें।\n\nसब ठीक। क्या हुआ?',
    "操作员说：“等待。停机。”接着离开。组长说：“不行。”所以停下。「先测量。再清洗。」这条规定写在墙上。“好。”工人说。他问：“可以吗？”没有回答。",
    "「待て。次に測る。」と班長が言った。「だめだ。」とだけ書いた。『先に洗う。』と規定にある。「なぜか？」と聞いた。",
    "Prof. Lee and Mr. Dean left. Capt. Rowe met Rev. Shaw, and Sgt. Bell met Gen. Price. Ms. Cole saw Mrs. Dunn. Hr. Voss and Fr. Lang came. Mme. Roux met Mlle. Petit. Sra. Vega met Dra. Ruiz.",
    "قال المورد: «توقف.» ثم غادر. انظر الشكل 3. تم الفحص.\n\nلماذا توقف؟ لا أحد يعرف.",
)


def fitted(documents: DataFrame, key: str, text: str, sample_texts: int) -> Classifier:
    rows = documents.where(F.length(text).between(1, SAMPLE_LENGTH)).select(key, text).orderBy(F.xxhash64(key), key).limit(sample_texts).collect()
    return train([*SEEDS, *(r[text] for r in rows)])


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", sample_texts: int = 3_000, with_text: bool = False) -> DataFrame:
    """``(key, start_pos, end_pos)`` of every sentence; with ``with_text`` also ``sentence_no`` and ``sentence``."""
    model = fitted(documents, key, text, sample_texts)
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.usage))
    source = documents.where(F.col(text).isNotNull()).select(key, text)
    schema = f"{key} {dict(source.dtypes)[key]}, start_pos int, end_pos int" + (", sentence_no int, sentence string" if with_text else "")
    names = [key, "start_pos", "end_pos", "sentence_no", "sentence"][: 5 if with_text else 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(*shared.value)
        for b in batches:
            rows, starts, ends, numbers, parts = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for n, (s, e) in enumerate(split(t, classifier)):
                    rows.append(i)
                    starts.append(s)
                    ends.append(e)
                    if with_text:
                        numbers.append(n)
                        parts.append(t[s:e])
            arrays = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(numbers, pa.int32()), pa.array(parts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays[: len(names)], names=names)

    return source.mapInArrow(run, schema)
