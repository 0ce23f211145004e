"""The lines of a mail that its sender wrote for it (problem 6).

Every line gets a symbol from its prefix and neighbouring lines and further features from its punctuation, length, first
character, place and from how many mails hold the same line; a hidden Markov model over the labels header, new, quoted,
forwarded, signature and notice labels the lines of a mail together by its best path.  The model starts from the priors
below and is trained here without labelled mails: best paths over all mails re-estimate its probabilities, with the priors
as pseudo-counts.  Legal notices aren't told by their words: the model learns how lines of notices are built, placed and
repeated.  All mails are labelled, whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .encoding import MISREADINGS, misread

ROUNDS = 3
PSEUDO = 200.0
#: The states; a forwarded message is only entered by a line that marks one.
HEADER, NEW, QUOTED, FORWARD, SIGNATURE, NOTICE, FORWARD_MARK = range(7)
LABEL_NAMES = ("header", "new", "quoted", "forwarded", "signature", "notice", "forwarded")
SYMBOLS = ("blank", "head_top", "head_in", "more", "quote", "intro", "intro_part", "forward", "rule", "rule_head", "dashes", "close", "device", "list", "name", "greet", "text", "after_rule", "ps")
_AT = {s: i for i, s in enumerate(SYMBOLS)}
#: Values of each feature of a line: symbol, length and last character, first character, blanks around, lines below, repetition.
SIZES = (len(SYMBOLS), 9, 3, 6, 3, 3)
PLAIN = int(np.prod(SIZES[:-1]))
_DIGITS = np.array(np.unravel_index(np.arange(PLAIN * SIZES[-1]), SIZES[-1:] + SIZES[:-1]))[[1, 2, 3, 4, 5, 0]]
#: Cells of the sketch in which lines are counted; share and number of mails from which a line is repeated, and often so.
CELLS, REPEATED, OFTEN = 1 << 20, (2e-4, 3), (1e-3, 6)

#: Names of header fields, in the languages of the mails.
FIELDS = "from to cc bcc subject date sent reply-to sender message-id mime-version content-type content-transfer-encoding received return-path in-reply-to references delivered-to list-id importance priority organization user-agent de à a von an gesendet betreff datum objet envoyé date asunto para enviado fecha assunto data x-mailer"
#: Whole closing formulas.
CLOSINGS = "best|all the best|best wishes|best regards|kind regards|warm regards|regards|many thanks|thanks|thanks again|thank you|cheers|yours|yours sincerely|yours truly|sincerely|take care|mit freundlichen grüßen|viele grüße|liebe grüße|beste grüße|gruß|grüße|mfg|cordialement|bien cordialement|bien à vous|amicalement|merci|un saludo|saludos|atentamente|un abrazo|gracias|atenciosamente|abraços|obrigado|um abraço|с уважением|спасибо"
_FOREIGN = re.compile(r"[^\x00-\x7f]+")


def _fold(text: str) -> str:
    """Stretches outside ASCII as one sign, so that formulas are known however they were decoded."""
    return text if text.isascii() else _FOREIGN.sub("¿", text)


_TAG = re.compile(r"<(?![\w.+-]+@)/?[a-zA-Z][^<>]*>|&nbsp;|&#160;")
#: The quote mark outside ASCII, as it is and as its bytes are misread.
_MARKS = dict.fromkeys(("»", *(m for read in dict.fromkeys(r for r, w in MISREADINGS if w == "utf-8") for m in misread("»", read))))
_QUOTE = re.compile(rf"\s*(?:>|{'|'.join(map(re.escape, _MARKS))}|�\s|\|(?:\s|$)|:(?:\s|$)|[A-Z]{{1,3}}>)")
_FIELD = re.compile(r"[>\s*]*(?:X-[\w-]+|" + "|".join(dict.fromkeys(re.escape(_fold(f)) for f in FIELDS.split())) + r")\s?:(?:\*|\s|$)", re.I)
_VERB = _fold(r"(?:wrote|writes|said|schrieb|escribió|escribio|a écrit|escreveu)")
_INTRO_END = re.compile(rf"(?<!\w){_VERB}(?!\w)[^:]{{0,80}}:\s*$", re.I)
_INTRO_START = re.compile(r"\s*(?:on|am|le|el|em|in message|em mensagem)\b.*\d|\S.*<[^<>\s]+@[^<>\s]+>", re.I)
_INTRO_PART = re.compile(r"\s*(?:on|am|le|el|em)\b.*\d.{0,40},?\s*$|\s*in message <[^>]*>.*$", re.I)
_INTRO_ONLY = re.compile(rf"\s*(?:\S+\s+){{0,4}}(?:<[^<>]+>\s*)?{_VERB}(?!\w)[^:]{{0,60}}:\s*$", re.I)
_FORWARD = re.compile(r"\s*-{2,}\s?.*\b(?:message|nachricht|mensaje|mensagem|forwarded|original|transf¿r¿|weitergeleitet)\w*.*-{2,}\s*$|\s*begin forwarded message|\s*anfang der weitergeleiteten|\s*d¿but du message", re.I)
_RULE = re.compile(r"\s*(?:_{4,}|\*{4,}|={4,}|-{5,}|#{5,})\s*$")
_DASHES = re.compile(r"\s*(?:--|—|--\s)\s*$")
_CLOSE = re.compile(rf"\s*(?:{_fold(CLOSINGS)})\s*[,.!]*\s*$", re.I)
_DEVICE = re.compile(r"\s*(?:sent from (?:my|the)\b|sent via\b|gesendet von (?:meinem|mein)|von meinem .* gesendet|envoy¿ de(?:puis)? mon|enviado desde mi|enviado do meu|get \w+ for \w+\s*$)", re.I)
_LIST = re.compile(r"\s*(?:to leave|to unsubscribe|unsubscribe|to post)\s*:?\s*(?:http|\S+@)|.*\bmailing list\s*$|.*\blist service\s*$", re.I)
_WORD = r"[A-Za-z¿][\w'¿-]*"
_NAME = re.compile(rf"\s*(?:[~/]{_WORD}(?: {_WORD}){{0,2}}/?|[A-Z¿][\w'¿-]+(?: [A-Z¿][\w'¿-]*\.?){{0,2}}|[A-Z][\w ]{{2,25}}, {_WORD}(?: (?:Ltd|GmbH|SA|Inc|AG|LLC|Co|plc|SL)\.?)?|(?:phone|tel|fax|mobile|ext|cell)\b[.:]?\s*[+\d][\d ()-]*|https?://\S+|www\.\S+|\S+@\S+\.\S+|\".{{3,60}}\")\s*$")
_CONTACT = re.compile(r"\s*(?:(?:phone|tel|fax|mobile|ext|cell)\b[.:]?\s*[+\d][\d ()./-]*|https?://\S+|\"[^\"]{3,60}\")\s*$", re.I)
_GREET = re.compile(r"\s*(?:hi|hello|hey|dear|good (?:morning|afternoon|evening|day)|greetings|hola|buenos d¿as|buenas|guten|hallo|liebe[rs]?|sehr geehrte|salut|bonjour|cher|ch¿re|ol¿|oi|bom dia|caro)\b.{0,45}[,:!]?\s*$|\s*" + _WORD + r"(?: " + _WORD + r")?\s?[,:!]\s*$", re.I)
_PS = re.compile(r"\s*p\.?\s?s\.?\s*[:\-]", re.I)


def symbols(lines: list[str]) -> list[int]:
    """The feature symbol of every line of a mail."""
    n = len(lines)
    out = [0] * n
    top = True
    for i, raw in enumerate(lines):
        line = raw
        if "<" in line or "&" in line:
            line = _TAG.sub(" ", line)
        line = line.strip()
        if not line:
            out[i] = 0
            if not raw.strip() and i and top and out[i - 1]:
                top = False
            continue
        quoted = _QUOTE.match(line) and not line.startswith("-->")
        line = _fold(line)
        c = line[0]
        if quoted:
            s = "quote"
        elif ":" in line and _FIELD.match(line):
            s = "head_top" if top else "head_in"
        elif top and ":" in line[:25] and (i and out[i - 1] == 1 or i + 1 < n and _FIELD.match(lines[i + 1])) and not (i + 1 < n and not lines[i + 1].strip() and out[i - 1] != 1):
            s = "head_top"  # a field whose name is misspelt
        elif top and i and raw[:1] in " \t" and out[i - 1] in (1, 3):
            s = "more"
        elif _INTRO_END.search(line) and (_INTRO_START.match(line) or _INTRO_ONLY.match(line) and i and out[i - 1] == 6):
            s = "intro"
        elif (c == "-" or c in "bBaAdD") and _FORWARD.match(line):
            s = "forward"
        elif _RULE.match(line):
            s = "rule"
        elif _DASHES.match(line):
            s = "dashes"
        elif len(line) < 45 and _CLOSE.match(line):
            s = "close"
        elif _DEVICE.match(line):
            s = "device"
        elif _LIST.match(line):
            s = "list"
        elif len(line) < 70 and line[-1] in ",0123456789>" and _INTRO_PART.match(line) and i + 1 < n and _INTRO_END.search(lines[i + 1]) and _INTRO_ONLY.match(lines[i + 1].strip()):
            s = "intro_part"
        elif _PS.match(line):
            s = "ps"
        elif len(line) < 60 and (_NAME.match(line) or _CONTACT.match(line)):
            s = "name"
        elif len(line) < 60 and _GREET.match(line):
            s = "greet"
        else:
            s = "text"
        if s not in ("head_top", "more"):
            top = False
        out[i] = _AT[s]
    text, name, close, rule, greet, quote = (_AT[s] for s in ("text", "name", "close", "rule", "greet", "quote"))
    opening = (0, greet, _AT["head_top"], _AT["more"])
    heads = (_AT["head_in"], _AT["head_top"])
    before = 0
    for i in range(n):
        s = out[i]
        if s in (text, greet, name, close) and 0 < i < n - 1 and out[i - 1] == out[i + 1] == quote and len(lines[i].split()) < 3:
            out[i] = quote  # the rest of a quoted line that was wrapped
        elif s == close or s == name and lines[i].lstrip()[0] not in "~/":
            # a short line within a paragraph is running text, whatever it looks like
            # or first of all; a name stands below something
            if i and out[i - 1] == text or s == name and (before in opening or i + 1 < n and out[i + 1] == text and before == text):
                out[i] = text
        elif s == rule:
            follow = next((out[j] for j in range(i + 1, min(n, i + 4)) if out[j]), 0)
            if follow in heads:
                out[i] = _AT["rule_head"]
        elif s == text and before == rule and out[i - 1] == rule:
            out[i] = _AT["after_rule"]
        if out[i]:
            before = out[i]
    return out


def features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all features of every line but its repetition as one number, a hash of the line), blank lines as 0."""
    plain, hashes = np.zeros(len(lines), np.int32), np.zeros(len(lines), np.uint32)
    last = max((i for i, line in enumerate(lines) if line.strip()), default=0)
    blanks = 2
    for i, (line, symbol) in enumerate(zip(lines, symbols(lines), strict=True)):
        line = line.strip()
        if not symbol:  # blank, or nothing but markup
            blanks = min(blanks + 1, 2)
            continue
        words = len(line.split())
        length = 0 if words < 4 else 1 if words < 9 else 2
        end = 0 if line[-1] in ".!?" else 1 if line[-1] in ",:;" else 2
        start = 0 if line[0].isupper() else 1 if line[0].islower() else 2
        around = 2 * blanks + (i + 1 < len(lines) and lines[i + 1].strip() != "")
        below = 0 if last - i < 4 else 1 if last - i < 9 else 2
        plain[i] = (((symbol * 9 + 3 * length + end) * 3 + start) * 6 + around) * 3 + below
        hashes[i] = zlib.crc32(_fold(line).lower().encode("utf-8", "replace")) | 1
        blanks = 0
    return plain, hashes


def prior() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Probabilities of first labels, of label after label, and of each feature under a label, before training."""
    never = 1e-30
    start = np.array([0.4, 0.4, 0.15, never, 0.005, 0.005, 0.04])
    # from: header, new, quoted, forwarded, signature, notice, mark of a forward; nothing is newly written below a forward
    step = np.array([
        [0.90, 0.05, 0.03, never, 1e-6, 1e-6, 0.02],
        [1e-9, 0.90, 0.04, never, 0.04, 0.01, 0.01],
        [1e-9, 0.06, 0.90, never, 0.015, 0.015, 0.01],
        [never, never, never, 0.999, never, 1e-3, 1e-6],
        [1e-9, 1e-5, 0.03, never, 0.90, 0.04, 0.03],
        [1e-9, 1e-5, 0.01, never, 0.01, 0.97, 0.01],
        [never, never, never, 0.60, never, never, 0.40],
    ])
    tiny = 1e-7
    emit = np.full((7, len(SYMBOLS)), tiny)

    def give(label: int, **weights: float) -> None:
        for symbol, w in weights.items():
            emit[label, _AT[symbol]] = w

    give(HEADER, head_top=0.85, more=0.1, blank=0.05)
    give(NEW, text=0.7, blank=0.2, greet=0.05, name=2e-4, close=1e-5, ps=0.01, after_rule=0.001, head_in=1e-4, more=1e-4, list=1e-5)
    give(QUOTED, quote=0.8, intro=0.1, intro_part=0.02, blank=0.08, text=1e-4)
    give(FORWARD, forward=0.05, rule_head=0.02, head_in=0.2, head_top=0.02, text=0.5, blank=0.2, greet=0.01, name=0.02, close=0.01, quote=0.01, intro=0.005, dashes=0.01, device=0.005, rule=0.003, after_rule=0.003, list=0.002, intro_part=0.001)
    give(FORWARD_MARK, forward=0.5, rule_head=0.3, head_in=0.2)
    give(SIGNATURE, close=0.2, name=0.4, dashes=0.15, device=0.05, blank=0.2, rule=0.05, after_rule=0.05, text=0.002, greet=0.002, list=0.02, ps=1e-5)
    give(NOTICE, text=0.6, blank=0.12, list=0.12, rule=0.08, after_rule=0.05, name=0.02, greet=0.005, close=0.001)
    again = np.full((7, 3), 1.0)
    again[NEW], again[NOTICE], again[FORWARD] = (0.94, 0.04, 0.02), (0.05, 0.15, 0.8), (0.9, 0.07, 0.03)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return norm(start), norm(step), [norm(emit), *(norm(np.ones((7, n))) for n in SIZES[1:-1]), norm(again)]


def emission(tables: list[np.ndarray]) -> np.ndarray:
    """Probabilities of all features of a line together under each label; a blank line has none but its symbol."""
    out = tables[0][:, _DIGITS[0]]
    for table, digit in zip(tables[1:], _DIGITS[1:], strict=True):
        out = out * np.where(_DIGITS[0] == 0, 1.0, table[:, digit])
    return out


def best_paths(runs: list, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The most probable labels of each run of lines by their features; all runs step together, so that no Python loop is per line."""
    start, step, emit = (np.log(x) for x in (*model[:2], emission(model[2])))
    size = np.array([len(r) for r in runs])
    if not len(size) or not size.sum():
        return [np.zeros(0, np.int8) for _ in runs]
    order = np.argsort(-size, kind="stable")
    ends = np.cumsum(size[order]) - size[order]
    flat = np.concatenate([np.asarray(runs[i], np.int32) for i in order])
    active = np.array([(size > t).sum() for t in range(size.max())])
    back = []
    score = start + emit[:, flat[ends[: active[0]]]].T
    final = np.zeros(len(runs), np.int8)
    for t in range(1, len(active)):
        k = active[t]
        done = score[k:]
        final[k : k + len(done)] = done.argmax(axis=1)
        ways = score[:k, :, None] + step
        came = ways.argmax(axis=1).astype(np.int8)
        score = np.take_along_axis(ways, came[:, None, :].astype(np.int64), axis=1)[:, 0] + emit[:, flat[ends[:k] + t]].T
        back.append(came)
    final[: len(score)] = score.argmax(axis=1)
    labels = np.zeros(len(flat), np.int8)
    now = final.copy()
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        labels[ends[:k] + t] = now[:k]
        if t:
            now[:k] = back[t - 1][np.arange(k), now[:k]]
    out: list = [None] * len(runs)
    for j, i in enumerate(order):
        out[i] = labels[ends[j] : ends[j] + size[i]]
    return out


def path_counts(runs: list, model: tuple) -> np.ndarray:
    """First labels, steps and values of each feature on the best paths of ``runs``, one after the other in a flat array."""
    base = prior()
    first, step, seen = np.zeros(7), np.zeros((7, 7)), np.zeros((7, _DIGITS.shape[1]))
    for run, path in zip(runs, best_paths(runs, model), strict=True):
        if len(path):
            first[path[0]] += 1
            np.add.at(step, (path[:-1], path[1:]), 1)
            np.add.at(seen, (path, run), 1)
    tables = []
    for table, digit in zip(base[2], _DIGITS, strict=True):
        which = seen if not tables else np.where(_DIGITS[0] == 0, 0, seen)
        tables.append(np.stack([np.bincount(digit, w, minlength=table.shape[1]) for w in which]))
    return np.concatenate([c.ravel() for c in (first, step, *tables)])


def _estimated(found: np.ndarray) -> tuple:
    """The model of :func:`path_counts`, with the priors as pseudo-counts; what the priors all but rule out isn't learned."""
    start, step, tables = prior()
    base = [start, step, *tables]
    counts = [c.reshape(p.shape) for p, c in zip(base, np.split(found, np.cumsum([p.size for p in base])[:-1]), strict=True)]
    counts[1], counts[2] = np.where(step < 1e-3, 0, counts[1]), np.where(tables[0] < 5e-4, 0, counts[2])
    new = [p * PSEUDO + c for p, c in zip(base, counts, strict=True)]
    new = [c / c.sum(axis=-1, keepdims=True) for c in new]
    return new[0], new[1], new[2:]


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(8)).astype(np.int64) % CELLS


def repetition(counts: np.ndarray, mails: int) -> np.ndarray:
    """0, 1 or 2 for each cell: lines that few mails hold, some, or many."""
    share = counts / max(mails, 1)
    return ((share >= REPEATED[0]) & (counts >= REPEATED[1])).astype(np.uint8) + ((share >= OFTEN[0]) & (counts >= OFTEN[1]))


def _joined(plain: np.ndarray, hashes: np.ndarray, again: np.ndarray) -> np.ndarray:
    return plain + PLAIN * np.where(hashes == 0, 0, again[_cell(hashes)]).astype(np.int32)


def train(mails: list[str]) -> tuple[tuple, np.ndarray]:
    """(model after ROUNDS of re-estimation from the best paths over ``mails``, repetition of lines)."""
    found = [features(m.split("\n")) for m in mails]
    counts = np.zeros(CELLS, np.int64)
    for _, hashes in found:
        counts[np.unique(_cell(hashes[hashes > 0]))] += 1
    again = repetition(counts, len(mails))
    runs, model = [_joined(*f, again) for f in found], prior()
    for _ in range(ROUNDS):
        model = _estimated(path_counts(runs, model))
    return model, again


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(m.split("\n")) for m in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i].tobytes() for f in found], pa.binary()) for i in (0, 1))], names=["id", "run", "hashes"])


_PIECE = 1 << 15


def _line_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many mails of a task the lines of each cell stand, in packed pieces."""
    counts = np.zeros(CELLS, np.uint32)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            hashes = np.frombuffer(raw, np.uint32)
            counts[np.unique(_cell(hashes[hashes > 0]))] += 1
    for c in range(0, CELLS, _PIECE):
        if counts[c : c + _PIECE].any():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([zlib.compress(counts[c : c + _PIECE].tobytes(), 1)])], names=["piece", "counts"])


def _repetition(mails: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.int64)
                sums[c] = sums[c] + counts if c in sums else counts
        for c, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([repetition(counts, mails).tobytes()])], names=["piece", "again"])

    return run


def _counts(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, again = model.value
        found = sum(path_counts(_read(batch, 0, again), told) for batch in batches)
        if isinstance(found, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found)], names=["cell", "n"])

    return run


def _read(batch: pa.RecordBatch, at: int, again: np.ndarray) -> list[np.ndarray]:
    columns = (batch.column(at).to_pylist(), batch.column(at + 1).to_pylist())
    return [_joined(np.frombuffer(p, np.int32), np.frombuffer(h, np.uint32), again) for p, h in zip(*columns, strict=True)]


def train_on_all(runs: DataFrame) -> tuple[tuple, np.ndarray]:
    """:func:`train` over all mails of ``runs(run, hashes)``: a round adds up one array of fixed size where the mails lie."""
    spark = runs.sparkSession
    again = np.zeros(CELLS, np.uint8)
    pieces = runs.select("hashes").mapInArrow(_line_counts, "piece int, counts binary").repartition("piece")
    for c, raw in pieces.mapInArrow(_repetition(runs.count()), "piece int, again binary").collect():
        again[c : c + _PIECE] = np.frombuffer(raw, np.uint8)
    model = prior()
    for _ in range(ROUNDS):
        summed = runs.select("run", "hashes").mapInArrow(_counts(spark.sparkContext.broadcast((model, again))), "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n"))
        found = np.zeros(sum(p.size for p in (*model[:2], *model[2])))
        for r in summed.collect():
            found[r.cell] = r.n
        model = _estimated(found)
    return model, again


def _label(model, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, again = model.value
        for batch in batches:
            ids = np.asarray(batch.column(0))
            runs = _read(batch, 1, again)
            paths = best_paths(runs, told)
            size = np.array([len(r) for r in runs])
            blank = np.concatenate([r == 0 for r in runs]) if runs else np.zeros(0, bool)
            label = np.concatenate(paths) if paths else np.zeros(0, np.int8)
            number = np.arange(len(label)) - np.repeat(np.cumsum(size) - size, size) + 1
            owner = np.repeat(np.arange(len(ids)), size)
            keep = np.flatnonzero(~blank & ((label == NEW) | every))
            cols = [pa.array(ids[owner[keep]], pa.int64()), pa.array(number[keep].astype(np.int32))]
            if every:
                cols.append(pa.array(np.array(LABEL_NAMES, object)[label[keep]], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["id", "line_no", "label"][: len(cols)])

    return run


def _prepared(rows: DataFrame):
    rows = rows.select(F.col("id").cast("long"), F.col("text").cast("string")).where("id IS NOT NULL AND text IS NOT NULL")
    runs = cut(rows.mapInArrow(_features, "id long, run binary, hashes binary"), "features")
    return runs, rows.sparkSession.sparkContext.broadcast(train_on_all(runs))


def new_lines(rows: DataFrame) -> DataFrame:
    """(id, line_no) of the lines of ``rows(id, text)`` that were newly written, each once; lines are split at ``\\n``.

    Blank lines, null and empty texts and null ids give no row; repeated rows of an id count once; an empty table gives an
    empty result.
    """
    runs, model = _prepared(rows)
    return runs.mapInArrow(_label(model, False), "id long, line_no int").dropDuplicates(["id", "line_no"])


def labelled_lines(rows: DataFrame) -> DataFrame:
    """(id, line_no, label) of every line that isn't blank, see :func:`new_lines`; labels as in LABEL_NAMES."""
    runs, model = _prepared(rows)
    return runs.mapInArrow(_label(model, True), "id long, line_no int, label string").dropDuplicates(["id", "line_no"])
