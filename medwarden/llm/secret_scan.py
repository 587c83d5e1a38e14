"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags tokens as secret begin, inside or outside from their shape, their neighbours and
features of the file. It is trained here on windows around the patterns' own matches, and decoded
by Viterbi. Far from any digit, sign or known word a token is outside on every best path (checked
against the weights before use), so only the stretches between such tokens are decoded; the
result is that of decoding the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medwarden.llm.common import stage, text_of

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20
# Windows the field is trained on, at most, and words it knows by name.
MAX_WINDOWS = 2_000
MAX_NAMED = 24
EPOCHS = 100
RATE, DECAY = 0.1, (0.9, 0.99)
RIDGE = 0.05

BEGIN, INSIDE, OUTSIDE = 0, 1, 2
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"[\w+/=-]+(?:\.[\w+/=-]+)*|[^\w\s]")
_ODD = re.compile(r"""[0-9_=:/+"']+""")
_CHUNK = re.compile(r"\S+")
# Chunks of text on each side of an odd one in a training window.
_CONTEXT = 6
# Shapes of tokens without a digit or odd sign, and the end of the text.
_PLAIN = ("lower", "title", "upper", "mixed", "long", "p", "p-", "edge")


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the patterns, in order of start and kind."""
    found = []
    if any(k in text.lower() for k in ("passw", "secret", "token", "api")):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= MIN_VALUE:
                found.append((m.start(), 0, m.end(), m.start(2)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                found.append((m.start(), 1, m.end(), m.start()))
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def shape(token: str) -> str:
    if len(token) == 1 and not token.isalnum():
        return f"p{token}" if token in "=:\"'" else "p-" if token == "-" else "p"
    if token.isalpha():
        if len(token) > 30:
            return "long"
        return (
            "lower" if token.islower() else "upper" if token.isupper()
            else "title" if token.istitle() else "mixed"
        )
    n = len(token)
    size = "s" if n < 8 else "m" if n < 16 else "l" if n < 24 else "x"
    if token.isdigit():
        return f"num{size}"
    if re.fullmatch(r"[0-9a-f]+", token):
        return f"hex{size}"
    if re.fullmatch(r"[A-Z0-9]+", token):
        return f"caps{size}"
    if re.fullmatch(r"[A-Za-z0-9]+", token):
        return f"alnum{size}"
    digit = "d" if any(c.isdigit() for c in token) else ""
    return f"sep{digit}{size}"


def file_features(text: str) -> tuple[str, str]:
    low = text.lower()
    odd = sum(text.count(c) for c in '=:"')
    share = 1000 * odd // max(1, len(text))
    return (
        "key" if any(k in low for k in _KEYWORDS) else "nokey",
        "code" if share >= 20 else "some" if share else "prose",
    )


def features(tokens: list[str], file: tuple[str, str], named: frozenset[str]) -> list[list[str]]:
    """Feature names of every token: a slot and its value."""
    n = len(tokens)
    shapes = ["edge", "edge", *map(shape, tokens), "edge"]
    names = ["-"] * 3 + [w if (w := t.lower()) in named else "-" for t in tokens]
    return [
        [
            f"s0 {shapes[i + 2]}", f"s-1 {shapes[i + 1]}", f"s-2 {shapes[i]}",
            f"s+1 {shapes[i + 3]}", f"w-1 {names[i + 2]}", f"w-2 {names[i + 1]}",
            f"w-3 {names[i]}", f"f {file[0]}", f"g {file[1]}",
        ]
        for i in range(n)
    ]


class Field:
    """Weights of a trained field.

    ``around`` is how many plain tokens away from an odd one a token is provably outside, or None
    where the weights allow no such bound. Turning a plain token from begin or inside to outside
    gains ``m`` at least, transitions between marked tokens included. A marked stretch within plain
    text then loses against none. One that reaches an odd token over ``around`` plain ones loses
    too: those gain more than all that the stretch's new end or begin can cost.
    """

    def __init__(self, weights: dict[str, list[float]], moves: list[list[float]], named: list[str]):
        self.weights, self.moves, self.named = weights, moves, frozenset(named)
        best = {}  # slot and tag -> most that a plain token or a feature of the file adds to the tag
        turn = {}  # slot -> most that any token adds when it begins instead of going on, or back
        for name, w in weights.items():
            slot, value = name.split(" ", 1)
            turn[slot] = max(turn.get(slot, 0.0), abs(w[BEGIN] - w[INSIDE]))
            if slot[0] in "fg" or value == "-" or value in _PLAIN[: -1 if slot == "s0" else None]:
                for tag in (BEGIN, INSIDE):
                    lift = w[tag] - w[OUTSIDE]
                    # A token's own plain shape may be unseen in training, which adds nothing.
                    best[slot, tag] = max(best.get((slot, tag), lift), lift)
        for v in _PLAIN[:-1]:
            if f"s0 {v}" not in weights:
                best |= {("s0", t): max(best.get(("s0", t), 0.0), 0.0) for t in (BEGIN, INSIDE)}
        other = {s for s, _ in best} - {"s0"}
        lifts = [
            best.get(("s0", t), 0.0) + sum(max(0.0, best[s, t]) if s[0] not in "fgw" else best[s, t] for s in other)
            for t in (BEGIN, INSIDE)
        ]
        stay = max(moves[a][b] for a in (BEGIN, INSIDE) for b in (BEGIN, INSIDE))
        out = moves[OUTSIDE][OUTSIDE]
        m = -max(lifts) - max(0.0, stay - out)
        leave = max(moves[BEGIN][OUTSIDE], moves[INSIDE][OUTSIDE], moves[OUTSIDE][BEGIN])
        self.around = None
        if m > 0 and m + 2 * out - moves[OUTSIDE][BEGIN] - leave > 0:
            cost = sum(turn.values()) + 4 * (max(map(max, moves)) - min(map(min, moves)))
            # Three more, as a token's features look that far back.
            self.around = int(cost / m) + 4

    def tags(self, tokens: list[str], file: tuple[str, str]) -> list[int]:
        """The best tag sequence, by Viterbi; ties go to the earlier tag."""
        if not tokens:
            return []
        scores, back = None, []
        none = (0.0, 0.0, 0.0)
        get, moves = self.weights.get, self.moves
        for names in features(tokens, file, self.named):
            e0 = e1 = e2 = 0.0
            for name in names:
                w = get(name, none)
                e0, e1, e2 = e0 + w[0], e1 + w[1], e2 + w[2]
            emit = (e0, e1, e2)
            if scores is None:  # the text before is outside
                scores = [moves[OUTSIDE][t] + emit[t] for t in range(3)]
                continue
            step, came = [], []
            for t in range(3):
                best = max(range(3), key=lambda s, t=t: scores[s] + moves[s][t])
                came.append(best)
                step.append(scores[best] + moves[best][t] + emit[t])
            scores = step
            back.append(came)
        tag = max(range(3), key=lambda s: scores[s] + moves[s][OUTSIDE])
        path = [tag]
        for came in reversed(back):
            tag = came[tag]
            path.append(tag)
        return path[::-1]

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        file = file_features(text)
        for lo, hi in self.stretches(text):
            found = list(_TOKEN.finditer(text, lo, hi))
            start = end = None
            for m, tag in zip(found, self.tags([m[0] for m in found], file), strict=True):
                if start is not None and tag != INSIDE:
                    yield start, end
                    start = None
                if tag == BEGIN or tag == INSIDE and start is None:
                    start = m.start()
                end = m.end()
            if start is not None:
                yield start, end

    def stretches(self, text: str) -> list[tuple[int, int]]:
        whole = [(0, len(text))]
        return whole if self.around is None else stretches(text, self.named, self.around)


def stretches(text: str, named: frozenset[str], around: int) -> list[tuple[int, int]]:
    """Ranges around odd signs and known words, with ``around`` chunks of text on each side."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    at = [(m.start(), m.end()) for m in _ODD.finditer(text)]
    for word in named:
        i = low.find(word)
        while i >= 0:
            at.append((i, i + len(word)))
            i = low.find(word, i + len(word))
    found: list[tuple[int, int]] = []
    for start, end in sorted(at):
        if found and end <= found[-1][1] and start >= found[-1][0] and _inside(text, end, found[-1][1], around):
            continue
        lo, hi = _widened(text, start, end, around)
        if found and lo <= found[-1][1]:
            found[-1] = (found[-1][0], max(hi, found[-1][1]))
        else:
            found.append((lo, hi))
    return found


def _inside(text: str, end: int, hi: int, around: int) -> bool:
    """Whether ``around`` whole chunks follow ``end`` before ``hi`` already."""
    return len(text[end:hi].split(None, around + 1)) > around + 1


def _widened(text: str, start: int, end: int, around: int) -> tuple[int, int]:
    """The range from the start of the ``around`` chunks before to the end of those after."""
    span = 16 * around
    while True:
        left = [m.start() for m in _CHUNK.finditer(text, max(0, start - span), start)]
        # The first one may be cut off by the span; the last may be part of the odd one.
        if len(left) > around + 2 or span >= start:
            break
        span *= 4
    lo = left[-around - 1 :][0] if left else start
    span = 16 * around
    while True:
        right = [m.end() for m in _CHUNK.finditer(text, end, end + span)]
        if len(right) > around + 2 or end + span >= len(text):
            break
        span *= 4
    hi = right[: around + 1][-1] if right else end
    return lo, hi


def labelled(text: str) -> Iterator[tuple[list[str], list[int], list[str]]]:
    """Windows of a text with the tags its patterns give: (tokens, tags, file features)."""
    spans = base_spans(text)
    file = list(file_features(text))
    for lo, hi in stretches(text, frozenset(_KEYWORDS), _CONTEXT):
        tokens, tags, previous = [], [], None
        for m in _TOKEN.finditer(text, lo, hi):
            hit = next((s for s in spans if s[3] < m.end() and m.start() < s[2]), None)
            tags.append(OUTSIDE if hit is None else INSIDE if hit == previous else BEGIN)
            tokens.append(m[0])
            previous = hit
        yield tokens[:200], tags[:200], file


def train(windows: list[tuple[list[str], list[int], list[str]]]) -> Field:
    """Penalised maximum likelihood by Adam over all windows at once; the same windows give the same
    field."""
    near, total = Counter(), Counter()
    for tokens, tags, _ in windows:
        plain = [t.lower() if len(t) > 2 and t.isalpha() and t.isascii() else "" for t in tokens]
        total.update(plain)
        for i, tag in enumerate(tags):
            if tag == BEGIN:
                near.update(set(plain[max(0, i - 3) : i]) - {""})
    # Words that mostly stand before a secret; an everyday word would name half of any text.
    telling = [w for w, n in near.items() if n > 1 and 2 * n >= total[w]]
    named = sorted(sorted(telling, key=lambda w: (-near[w], w))[:MAX_NAMED])
    ids: dict[str, int] = {}
    rows = []
    for tokens, tags, file in windows:
        if tokens:
            names = features(tokens, tuple(file), frozenset(named))
            rows.append(([[ids.setdefault(x, len(ids)) for x in f] for f in names], tags))
    if not any(t != OUTSIDE for _, tags in rows for t in tags):
        # Nothing to learn from: everything is outside.
        return Field({f"s0 {v}": [-9.0, -9.0, 9.0] for v in _PLAIN}, [[0.0] * 3] * 3, [])
    n, long = len(rows), max(len(t) for _, t in rows)
    width = len(rows[0][0][0])
    feat = np.full((n, long, width), len(ids))
    gold = np.full((n, long), OUTSIDE)
    mask = np.zeros((n, long), bool)
    for i, (f, tags) in enumerate(rows):
        feat[i, : len(tags)], gold[i, : len(tags)], mask[i, : len(tags)] = f, tags, True
    # Weights of the features, of none (padding), and of the moves between tags, as one matrix.
    theta = np.zeros((len(ids) + 1 + 3, 3))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    hot = np.eye(3)[gold] * mask[..., None]
    before = np.concatenate([np.full((n, 1), OUTSIDE), gold[:, :-1]], axis=1)
    gold_moves = np.zeros((3, 3))
    for a, b in product(range(3), repeat=2):
        gold_moves[a, b] = ((before == a) & (gold == b) & mask).sum()
    lengths = mask.sum(axis=1)
    for epoch in range(1, EPOCHS + 1):
        weights, moves = theta[:-3], theta[-3:]
        emit = weights[feat].sum(axis=2) * mask[..., None]
        expect, expect_moves = _expected(emit, moves, mask, lengths)
        diff = hot - expect
        grad = -RIDGE * theta
        for slot in range(width):
            np.add.at(grad, feat[..., slot][mask], diff[mask])
        grad[-3:] += gold_moves - expect_moves
        first = DECAY[0] * first + (1 - DECAY[0]) * grad
        second = DECAY[1] * second + (1 - DECAY[1]) * grad**2
        step = first / (1 - DECAY[0] ** epoch)
        theta = theta + RATE * step / (np.sqrt(second / (1 - DECAY[1] ** epoch)) + 1e-9)
        theta[len(ids)] = 0
    weights, moves = theta[:-3], theta[-3:]
    found = {name: weights[i].round(6).tolist() for name, i in ids.items()}
    return Field(found, moves.round(6).tolist(), named)


def _expected(emit, moves, mask, lengths) -> tuple[np.ndarray, np.ndarray]:
    """Expected tags and moves under the field, by forward and backward sums in log space."""
    n, long, _ = emit.shape
    forward, backward = np.zeros((n, long, 3)), np.zeros((n, long, 3))
    forward[:, 0] = moves[OUTSIDE] + emit[:, 0]
    for i in range(1, long):
        step = np.logaddexp.reduce(forward[:, i - 1, :, None] + moves, axis=1) + emit[:, i]
        forward[:, i] = np.where(mask[:, i, None], step, forward[:, i - 1])
    for i in range(long - 2, -1, -1):
        step = np.logaddexp.reduce((emit[:, i + 1] + backward[:, i + 1])[:, None, :] + moves, axis=2)
        backward[:, i] = np.where(mask[:, i + 1, None], step, backward[:, i + 1])
    total = np.logaddexp.reduce(forward[np.arange(n), lengths - 1], axis=1)
    expect = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
    pair = (
        forward[:, :-1, :, None] + moves + (emit[:, 1:] + backward[:, 1:])[:, :, None, :]
        - total[:, None, None, None]
    )
    pair = np.exp(np.where(mask[:, 1:, None, None], pair, -np.inf)).sum(axis=(0, 1))
    pair[OUTSIDE] += expect[:, 0].sum(axis=0)
    return expect, pair


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Train on at most ``MAX_WINDOWS`` windows, half of them with a match where there are enough:
    those of the lowest hash among the windows of all texts."""
    rows = docs.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    most = MAX_WINDOWS // 2
    out = "hit boolean, h bigint, tokens array<string>, tags array<int>, file array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if not _ODD.search(text):
                    continue
                for tokens, tags, file in labelled(text):
                    h = xxhash.xxh64_intdigest(" ".join(tokens)) >> 1
                    held[min(tags, default=OUTSIDE) != OUTSIDE].append((h, tokens, tags, file))
            for hit in held:
                if len(held[hit]) > 2 * most:  # a task keeps no more than the whole could take
                    held[hit] = sorted(held[hit])[:most]
        found = [(hit, *w) for hit in held for w in sorted(held[hit])[:most]]
        columns = list(zip(*found, strict=True)) or [[]] * 5
        types = [pa.bool_(), pa.int64(), *map(pa.list_, (pa.string(), pa.int32(), pa.string()))]
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
            names=["hit", "h", "tokens", "tags", "file"],
        )

    windows = stage(rows.mapInArrow(run, out), "windows")
    picked = []
    for hit in (True, False):
        part = windows.filter(F.col("hit") == hit).orderBy("h", "tokens", "tags", "file")
        picked += part.limit(most).collect()
    return train([(r.tokens, r.tags, r.file) for r in picked])


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) spans of the patterns, and all spans: the field's own where none overlaps."""
    base = [(s, k, e) for s, k, e, _ in base_spans(text)]
    added = [
        (s, 3, e) for s, e in field.spans(text) if not any(b[0] < e and s < b[2] for b in base)
    ]
    return base, sorted([*base, *added])


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None
) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_crf) per row of ``docs``.

    Positions are code points, ends exclusive; the span of an assignment is the whole match. A
    NULL text is scanned as empty: no spans, the hash of nothing. Repeated rows are scanned alike;
    an empty table gives no rows. Without ``field`` one is trained on the table itself.
    """
    field = fit(docs, id_col, text_col) if field is None else field
    model = (field.weights, field.moves, sorted(field.named))
    rows = text_of(docs, id_col, text_col)
    schema = T.StructType(
        [T.StructField("_id", rows.schema["_id"].dataType)]
        + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
        + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*model)
        for batch in batches:
            made = []
            for text in batch.column(1):
                base, spans = scan(text.as_py() or "", own)
                kinds = Counter(k for _, k, _ in spans)
                sha = hashlib.sha256(_digest(base).encode()).hexdigest()
                made.append([*(kinds[k] for k in range(len(KINDS))), sha, _digest(spans)])
            columns = list(zip(*made, strict=True)) if made else [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.record_batch(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                names=schema.names,
            )

    found = rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
    return found.select(
        id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"
    )
