"""Text garbled by a wrong character encoding (problem 4): finds the records, and restores them where that can be done.

Stretches of characters outside ASCII are tried under every chain of up to two wrong readings (written in one encoding,
read in another).  Each result is compressed with a zstandard dictionary of each language; the chain whose compressed
length plus chain cost is least is taken, and the stretch stays as it is where no chain beats leaving it alone.  The
dictionaries are made here, from counts over the whole collection: the words of every language that no chain turns into a
more frequent word, the most frequent ones that fit.  A replacement character or a C1 control marks a
record even where nothing can be restored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Most bytes of one language's dictionary.
DICTIONARY_BYTES = 1 << 15

#: Fixed values: (encoding a text was wrongly read in, encoding it was written in).
MISREADINGS = (
    ("cp1252", "utf-8"),
    ("latin-1", "utf-8"),
    ("mac_roman", "utf-8"),
    ("cp437", "utf-8"),
    ("cp850", "utf-8"),
    ("cp1250", "utf-8"),
    ("cp1251", "utf-8"),
    ("koi8_r", "utf-8"),
    ("cp866", "utf-8"),
    ("cp1252", "cp1251"),
    ("cp1252", "koi8_r"),
    ("koi8_r", "cp1251"),
    ("cp1251", "koi8_r"),
    ("cp866", "cp1251"),
    ("cp1251", "cp866"),
)
#: Frequent words by which a line's language is told.
MARKERS = {
    "de": "und der die das nicht ist für über wir mit ein von zu dem den auch sich auf im es",
    "fr": "le la les des une est et que pour avec nous dans vous près sur déjà au qui pas ce",
    "es": "el los las del una que para con por más está según al se lo como su pero este también",
    "pt": "o os uma não para com em mais você são até também do da se",
    "ru": "и в не на что для до мы с по это как но за от к у из так же",
    "en": "the of and to is for with that you are this was from it",
}
_MARKERS = {lang: set(words.split()) for lang, words in MARKERS.items()}
_RUN = re.compile(r"[^\x00-\x7f]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: Cost in bytes of naming one wrong reading; single-byte pairs have no check of validity and need more evidence.
#: Bytes added for a restored character that no dictionary holds, unless the reading is one of the common ones.
STRANGE = 3
STEP_COST = {"utf-8": 1, "other": 2}


def _tables() -> dict[str, dict[str, int]]:
    """Byte of each character, by encoding; bytes that cp1252 leaves open stand for themselves, as most decoders have it."""
    out = {}
    for name in {m[0] for m in MISREADINGS}:
        table = {}
        for b in range(128, 256):
            try:
                table[bytes([b]).decode(name)] = b
            except UnicodeDecodeError:
                table[chr(b)] = b
        out[name] = table
    return out


_TABLES = _tables()


def _step(run: str, read: str, written: str) -> str | None:
    """``run`` as it would have been if its bytes had been read rightly; None if it can't have come from such bytes."""
    table = _TABLES[read]
    if written == "utf-8":
        out, pending, changed, left = [], bytearray(), False, 0
        for c in [*run, None]:
            b = None if c is None else table.get(c)
            if b is not None:
                pending.append(b)
                continue
            raw, at = bytes(pending), 0
            for m in _SEQUENCE.finditer(raw):
                try:
                    good = m[0].decode("utf-8")
                except UnicodeDecodeError:
                    continue
                out += [*_back(raw[at : m.start()], read), good]
                left += m.start() - at
                at, changed = m.end(), True
            out += _back(raw[at:], read)
            left += len(raw) - at
            pending.clear()
            if c is not None:
                out.append(c)
                left += 1
        return "".join(out) if changed and (not left or read in _PARTLY) else None
    raw = bytearray()
    for c in run:
        b = table.get(c)
        if b is None:
            return None
        raw.append(b)
    try:
        good = raw.decode(written)
    except UnicodeDecodeError:
        return None
    return good if _LETTERS.fullmatch(good) else None


#: Stretches that one-byte letters of another alphabet may have become: letters, and the signs beside them in its tables.
_SINGLE = re.compile("[" + "".join(re.escape(c) for c in sorted({c for read, written in MISREADINGS if written != "utf-8" for c, b in _TABLES[read].items() if bytes([b]).decode(written, "replace").isalpha()})) + "]+")

#: Readings under which part of a stretch may be right and part garbled.
_PARTLY = {"cp1252", "latin-1", "mac_roman", "cp437"}
_BACK = {name: {b: c for c, b in table.items()} for name, table in _TABLES.items()}


def _back(raw: bytes, read: str) -> list[str]:
    return [_BACK[read].get(b, chr(b)) for b in raw]


def misread(text: str, read: str, times: int = 2) -> list[str]:
    """``text`` as its UTF-8 bytes look when they are read in another encoding, once and again."""
    out = []
    for _ in range(times):
        text = "".join(_back(list(text.encode("utf-8")), read)) if not text.isascii() else text
        out.append(text)
    return out


def readings(run: str) -> Iterator[tuple[str, tuple[tuple[str, str], ...]]]:
    """Every text ``run`` may have been, with its chain, of one or two wrong readings."""
    seen = {run}
    once = []
    for first in MISREADINGS:
        one = _step(run, *first)
        if one is not None and one not in seen:
            seen.add(one)
            once.append((one, first))
            yield one, (first,)
    for one, first in once:
        if one.isascii() or first[1] != "utf-8":
            continue
        for second in MISREADINGS:
            two = _step(one, *second)
            if two is not None and two not in seen:
                seen.add(two)
                yield two, (first, second)


@dataclass
class Reader:
    """Decides on stretches with the dictionaries it is given; decisions are kept, as stretches recur."""

    dictionaries: dict[str, bytes]
    _coders: list = field(default_factory=list)
    _known: dict = field(default_factory=dict)
    _cost: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._alphabet = {c for d in self.dictionaries.values() for c in d.decode("utf-8")}

    def length(self, text: str) -> int:
        """Bytes of ``text`` under the dictionary that suits it best."""
        if text not in self._cost:
            if not self._coders:
                params = zstandard.ZstdCompressionParameters.from_level(19, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, window_log=17)
                for words in self.dictionaries.values():
                    d = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                    self._coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
            raw = text.encode("utf-8", "surrogatepass")
            if len(self._cost) > 200_000:
                self._cost.clear()
            self._cost[text] = min((len(c.compress(b" " + raw + b" ")) for c in self._coders), default=len(raw))
        return self._cost[text]

    def decide(self, run: str) -> tuple[str, tuple] | None:
        """(restored, chain) of the least description length, None to leave the stretch unchanged."""
        if run not in self._known:
            best, least = None, self.length(run)
            for text, chain in readings(run):
                if len(run) == 1 and chain[-1][1] != "utf-8":
                    continue
                cost = self.length(text) + self.chain_cost(text, chain)
                if cost < least:
                    best, least = (text, chain), cost
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[run] = best
        return self._known[run]

    def chain_cost(self, text: str, chain: tuple) -> int:
        cost = sum(STEP_COST["utf-8" if w == "utf-8" else "other"] for _, w in chain)
        if any(r not in _PARTLY for r, w in chain if w == "utf-8"):
            cost += STRANGE * sum(c not in self._alphabet for c in text)
        return cost

    def decide_line(self, runs: tuple[str, ...]) -> tuple | None:
        """The single wrong reading of a whole line, told from its stretches together where each is too short alone."""
        key = ("line", *runs)
        if key not in self._known:
            best, least = None, self.length(" ".join(runs))
            for step in MISREADINGS:
                if step[1] != "utf-8":
                    fixed = [_step(r, *step) for r in runs]
                    if all(fixed):
                        cost = self.length(" ".join(fixed)) + STEP_COST["other"]
                        if cost < least:
                            best, least = (step,), cost
            self._known[key] = best
        return self._known[key]

    def repair(self, text: str) -> tuple[str, list[str], bool]:
        """(restored text, names of the chains used, whether garbled characters remain)."""
        chains: dict[str, None] = {}
        lost = False
        out = []
        for line in text.split("\n"):
            if line.isascii():
                out.append(line)
                continue
            parts, at, single = [], 0, None
            runs = [(m.start(), m.end(), m[0], self.decide(m[0])) for m in _RUN.finditer(line)]
            for *_, d in runs:
                if d and d[1][-1][1] != "utf-8":
                    single = d[1]
            open_runs = tuple(run for *_, run, d in runs if d is None and _SINGLE.fullmatch(run))
            if single is None and len(open_runs) > 1 and max(map(len, open_runs)) > 1:
                single = self.decide_line(open_runs)
            for i, j, run, d in runs:
                if d is None and single and len(single) == 1:  # short words beside restored ones share their history
                    again = _step(run, *single[0])
                    d = (again, single) if again else None
                fixed = d[0] if d else run
                if d:
                    chains[">".join(f"{w}:{r}" for r, w in d[1])] = None
                lost |= any(c == "�" or "\x80" <= c <= "\x9f" for c in fixed)
                parts += [line[at:i], fixed]
                at = j
            out.append("".join(parts) + line[at:])
        return "\n".join(out), list(chains), lost


def _line_counts(texts: Iterable[str]) -> tuple[Counter, dict[str, Counter]]:
    """Times of each stretch outside ASCII, and of each stretch and word with such characters by the language of its line."""
    counts: dict[str, Counter] = {lang: Counter() for lang in _MARKERS}
    total: Counter = Counter()
    for text in texts:
        for line in text.split("\n"):
            if line.isascii():
                continue
            words = [w.lower() for w in _LETTERS.findall(line)]
            scores = {lang: sum(w in marks for w in words) for lang, marks in _MARKERS.items()}
            lang = max(scores, key=lambda x: (scores[x], x == "en"))
            for run in _RUN.findall(line):
                total[run] += 1
                counts[lang][run] += 1
            for word in _LETTERS.findall(line):
                if not word.isascii():
                    counts[lang][word] += 1
    return total, counts


def _rivals(run: str) -> set[str] | None:
    """What ``run`` may have been and must be as frequent as to be clean; None if it is garbled by its looks."""
    if any(c == "�" or "\x80" <= c <= "\x9f" for c in run):
        return None
    out = set()
    for text, chain in readings(run):
        if chain[-1][1] == "utf-8":
            return None
        out |= {text, text.lower(), text.title()}
    return out


def _packed(lang: str, words: Iterable[str]) -> bytes:
    """The dictionary of clean ``words``, most frequent first; they stand last in it."""
    body, size = [], 0
    for w in words:
        for form in dict.fromkeys((w, w.upper(), w.title())) if lang == "ru" else (w,):
            raw = f" {form} ".encode()
            if size + len(raw) <= DICTIONARY_BYTES:
                body.append(raw)
                size += len(raw)
    return b"".join(reversed(body)) if size >= 8 else b""


def train_dictionaries(texts: list[str]) -> dict[str, bytes]:
    """A dictionary for each language: its words with characters outside ASCII, the most frequent ones last."""
    total, counts = _line_counts(texts)
    clean = {}

    def is_clean(run: str) -> bool:
        if run not in clean:
            rivals = _rivals(run)
            clean[run] = rivals is not None and all(total[t] <= total[run] for t in rivals)
        return clean[run]

    ranked = lambda words: sorted((w for w, n in words.items() if n > 1), key=lambda w: (-words[w], w))
    found = {lang: _packed(lang, (w for w in ranked(words) if all(is_clean(r) for r in _RUN.findall(w)))) for lang, words in counts.items()}
    return {lang: words for lang, words in found.items() if words}


def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) as :func:`_line_counts` has it; stretches of any language have the language ``""``."""
    for batch in batches:
        total, counts = _line_counts(batch.column(0).to_pylist())
        rows = [(lang, w, n) for lang, words in (("", total), *counts.items()) for w, n in words.items()]
        yield _batch(rows, lang=pa.string(), word=pa.string(), n=pa.int64())


def _rival_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, n, rival); a stretch that is garbled by its looks has the rival null."""
    for batch in batches:
        rows = []
        for run, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rivals = _rivals(run)
            rows += [(run, n, t) for t in ((None,) if rivals is None else rivals)]
        yield _batch(rows, run=pa.string(), n=pa.int64(), rival=pa.string())


def collection_dictionaries(rows: DataFrame) -> dict[str, bytes]:
    """:func:`train_dictionaries` over all texts of ``rows(text)``, counted where they lie.

    Only the most frequent clean words of each language that a dictionary can hold reach the driver.
    """
    texts = rows.where(r"text RLIKE '[^\\x00-\\x7f]'").select("text")
    counts = texts.mapInArrow(_count_batches, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = cut(counts, "words")
    total = counts.where("lang = ''").select(F.col("word").alias("run"), "n")
    words = counts.where("lang <> '' AND n > 1").select("lang", "word", "n")
    rivals = total.mapInArrow(_rival_batches, "run string, n long, rival string")
    beaten = rivals.where("rival IS NOT NULL").join(total.select(F.col("run").alias("rival"), F.col("n").alias("other")), "rival").where("other > n")
    garbled_runs = rivals.where("rival IS NULL").select("run").unionByName(beaten.select("run")).distinct()
    runs = words.select("word", F.explode(F.regexp_extract_all("word", F.lit(r"[^\x00-\x7f]+"), F.lit(0))).alias("run")).distinct()
    clean = cut(words.join(runs.join(garbled_runs, "run", "left_semi").select("word"), "word", "left_anti"), "words")
    most = DICTIONARY_BYTES // len(" é ".encode())
    found = {}
    for lang in _MARKERS:
        first = clean.where(F.col("lang") == lang).orderBy(F.desc("n"), "word").limit(most).select("word").collect()
        found[lang] = _packed(lang, [r.word for r in first])
    return {lang: words for lang, words in found.items() if words}


def _run(reader, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader.value
        for batch in batches:
            ids, texts, chains, lost = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t is None or t.isascii():
                    continue
                fixed, how, bad = own.repair(t)
                if how or bad:
                    ids.append(i)
                    if whole:
                        texts.append(fixed)
                        chains.append(",".join(how))
                        lost.append(bad)
            cols = [pa.array(ids, pa.int64())]
            if whole:
                cols += [pa.array(texts, pa.string()), pa.array(chains, pa.string()), pa.array(lost, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "restored", "chains", "lost"][: len(cols)])

    return run


def garbled(rows: DataFrame, restore: bool = True) -> DataFrame:
    """(id, restored, chains, lost) of the records of ``rows(id, text)`` that hold garbled characters, each id once.

    ``restored`` is the text with every stretch undone that could be; ``chains`` names the wrong readings, empty if none
    could be undone; ``lost`` tells that garbled characters remain.  Without ``restore`` only the ids come out.  Null,
    empty and pure ASCII texts and rows with a null id have no row; an empty table gives an empty result.
    """
    rows = rows.select(F.col("id").cast("long"), F.col("text").cast("string")).where("id IS NOT NULL")
    reader = rows.sparkSession.sparkContext.broadcast(Reader(collection_dictionaries(rows)))
    found = rows.mapInArrow(_run(reader, restore), "id long" + ", restored string, chains string, lost boolean" * restore)
    return found.dropDuplicates(["id"])
