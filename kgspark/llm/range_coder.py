"""A range coder for token ids, mixing order-0 to order-2 predictions, over many independent blocks at a time.

Blocks share nothing, so the coder steps through all of them in lockstep: step t codes the t-th id of every block as
one set of NumPy operations.  For each block

* order 2 and order 1 predict one id each, the one last seen after the same two or one ids;
* order 0 spreads what is left over all ids by adaptive counts of buckets of ids, narrow for the frequent low ids;
* the shares of the two predictions are their hit rates so far at the same confidence.

What a model learns from CHUNK ids takes effect after them, counts and hit rates after more (``_REBUILDS``): so the
encoder predicts a whole chunk at once, and both learn from it at once.  The mixture is the interval table of a range
coder with a 48-bit range and 24-bit output words.  Its state is kept in doubles, which hold all integers up to 2**53;
carries of the low end are added to the words before when a block is complete.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Bits of the table of order 0, of all intervals, and of the hashed contexts.
ORDER0_BITS, TABLE_BITS, CONTEXT_BITS = 10, 24, 8
#: Ids of a block (shorter ones make more lanes and fewer steps for the same ids), and steps that are predicted from the same tables.
BLOCK_IDS, CHUNK = 1024, 16
#: Blocks coded in lockstep.
LANES = 2048
#: Largest share of a prediction, in 1/4096.
MOST = 3328
ID_LIMIT = 1 << 16
HEADER = struct.Struct("<4sIIII")  # magic, ids, bytes of payload, crc32 of the ids, crc32 of the payload
MAGIC = b"KGT2"

# Buckets of ids: they widen as ids grow, and wide ones have more slots at least, so that each id has an interval.
_WIDTH_BITS = np.concatenate([np.full(n, b) for b, n in ((4, 32), (6, 24), (8, 24), (10, 24), (12, 8))]).astype(np.int32)
_STARTS = np.concatenate(([0], np.cumsum(1 << _WIDTH_BITS)))[:-1].astype(np.int32)
N_BUCKETS = len(_WIDTH_BITS)
_BUCKET_OF = np.repeat(np.arange(N_BUCKETS), 1 << _WIDTH_BITS).astype(np.int32)
assert len(_BUCKET_OF) == ID_LIMIT

_SLOTS, _TOTAL = 1 << ORDER0_BITS, 1 << TABLE_BITS
_FEWEST = np.maximum(1, (1 << _WIDTH_BITS) // 512).astype(np.int32)
assert (_FEWEST * (((_TOTAL * (4096 - MOST) ** 2) >> (24 + ORDER0_BITS)) - 1) >> _WIDTH_BITS).min() >= 1
_CONTEXTS = (1 << CONTEXT_BITS) - 1
#: Steps before which the tables of counts and rates are made anew; all are multiples of CHUNK.
_REBUILDS = frozenset({32, 128, 512, 1152})
_RANGE, _LEAST, _WORD = float(1 << 48), float(1 << 24), float(1 << 24)


class Model:
    """The predictions of a number of blocks, all at the same step.

    Tables of order 2 and order 1 are rows of one array.  An entry of a context holds the predicted id and, above 16
    bits, the confidence in it: 0 (none) to 3.
    """

    def __init__(self, lanes: int, finding: bool) -> None:
        self.lanes, self.finding = lanes, finding
        self.entries = np.zeros((2, lanes << CONTEXT_BITS), np.int32)
        # hits and tries at each confidence, to begin with as if 0, 1/4, 1/2, 3/4 of a few tries had hit
        self.tries = np.tile(np.array([0.0, 4, 4, 4]), (2, lanes, 1))
        self.hits = np.tile(np.array([0.0, 1, 2, 3]), (2, lanes, 1))
        self.counts = np.tile(np.maximum(1, 16 >> (_WIDTH_BITS // 2)), (lanes, 1)).astype(np.int32)
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []
        self._places()
        self._tables()

    def _places(self) -> None:
        """Where the tables of each block begin."""
        row, order = np.arange(self.lanes), np.arange(2)[:, None]
        self.by_context = (row << CONTEXT_BITS) + order * (self.lanes << CONTEXT_BITS)
        self.by_rate = (row << 2) + order * (self.lanes << 2)
        self.by_bucket, self.by_slot = row * N_BUCKETS, row << ORDER0_BITS

    def keep(self, lanes: int) -> None:
        """Go on with the first blocks only."""
        self.seen = [(buckets[:, :lanes], sure[:, :, :lanes]) for buckets, sure in self.seen]
        self.lanes = lanes
        self.entries = np.ascontiguousarray(self.entries[:, : lanes << CONTEXT_BITS])
        self.tries, self.hits, self.counts = self.tries[:, :lanes], self.hits[:, :lanes], self.counts[:lanes]
        self._places()
        self._tables()

    def rebuild(self) -> None:
        """Take up the counts and hits since the tables were last made."""
        n = self.lanes
        buckets = np.concatenate([b for b, _ in self.seen]) + self.by_bucket
        self.counts = self.counts + 16 * np.bincount(buckets.ravel(), minlength=n * N_BUCKETS).reshape(n, N_BUCKETS).astype(np.int32)
        for k in (0, 1):
            codes = np.concatenate([s[k] for _, s in self.seen]) + (np.arange(n) << 3)
            got = np.bincount(codes.ravel(), minlength=8 * n).reshape(n, 2, 4)
            self.tries[k] += got.sum(axis=1)
            self.hits[k] += got[:, 1]
        self.seen = []
        self._tables()

    def _tables(self) -> None:
        rates = np.minimum(self.hits * 4096 / np.maximum(self.tries, 1), MOST).astype(np.int32)
        rates[:, :, 0] = 0
        self.rates = rates.ravel()
        share = _FEWEST + (self.counts * ((_SLOTS - _FEWEST.sum()) / self.counts.sum(axis=1, keepdims=True))).astype(np.int32)
        share[:, 0] += _SLOTS - share.sum(axis=1, dtype=np.int32)
        # the slots before a bucket, and its own
        self.packed = (((np.cumsum(share, axis=1, dtype=np.int32) - share) << 11) | share).ravel()
        if self.finding:
            self.slots = np.repeat(np.tile(np.arange(N_BUCKETS, dtype=np.uint8), self.lanes), share.ravel())

    def contexts(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Places in the tables of order 2 and order 1 after the last id ``one`` and the one before it."""
        h = np.empty((2, *one.shape), np.int64)
        np.multiply(one, 40_503, out=h[1])
        np.multiply(two, 29_989, out=h[0])
        h[0] += h[1]
        h >>= 6
        h &= _CONTEXTS
        h += self.by_context if one.ndim == 1 else self.by_context[:, None]
        return h

    def predict(self, contexts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Entries, predicted ids, share of order 2, shares of both and the unit of order 0, by the places."""
        entries = self.entries.ravel().take(contexts, mode="clip")
        guesses = entries & 0xFFFF
        rates = self.rates.take((entries >> 16) + (self.by_rate if contexts.ndim == 2 else self.by_rate[:, None]), mode="clip")
        second = rates[0] << (TABLE_BITS - 12)
        left = _TOTAL - second
        first = (left >> 12) * rates[1]
        first *= guesses[0] != guesses[1]
        left -= first
        return entries, guesses, second, _TOTAL - left, left >> ORDER0_BITS

    def learn(self, contexts: np.ndarray, entries: np.ndarray, ids: np.ndarray, buckets: np.ndarray) -> None:
        """Take up a chunk: contexts and entries by order, step and block, ids and buckets by step and block.

        If a context occurs again in a chunk, the last occurrence counts.
        """
        sure = entries >> 16
        hit = (entries & 0xFFFF) == ids
        lower = np.where(sure > 1, entries - 65_536, ids | 65_536)
        self.entries.ravel()[contexts] = np.where(hit, np.where(sure < 3, entries + 65_536, entries), lower)
        self.seen.append((buckets, (sure + 4 * hit).astype(np.uint8)))


def _active(lengths: np.ndarray, step: int) -> int:
    """Blocks that have an id at this step; lengths fall."""
    return int(np.searchsorted(-lengths, -step, "left"))


def _intervals(model: Model, contexts: np.ndarray, ids: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a chunk's contexts, and start and width of the interval of each id."""
    entries, guesses, second, both, unit = model.predict(contexts)
    packed = model.packed.take(buckets + model.by_bucket, mode="clip")
    width = ((packed & 2047) * unit) >> _WIDTH_BITS.take(buckets, mode="clip")
    start = both + (packed >> 11) * unit + (ids - _STARTS.take(buckets, mode="clip")) * width
    hit = (guesses[1] == ids) & (both > second)
    start, width = np.where(hit, second, start), np.where(hit, both - second, width)
    hit = (guesses[0] == ids) & (second > 0)
    return entries, np.where(hit, 0, start).astype(float), np.where(hit, second, width).astype(float)


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    lengths = np.array([len(b) for b in blocks])
    n = len(blocks)
    steps = -(-int(lengths.max()) // CHUNK) * CHUNK
    ids = np.zeros((steps + 2, n), np.int32)
    for k, b in enumerate(blocks):
        ids[2 : len(b) + 2, k] = b
    model = Model(n, finding=False)
    words, given = np.zeros((steps + 2, n), np.int32), np.zeros((steps + 2, n), bool)
    low, span = np.zeros(n), np.full(n, _RANGE)
    ends, live = np.zeros(n), n
    for t in range(0, steps, CHUNK):
        if (now := _active(lengths, t)) < live:
            ends[now:live] = low[now:]
            live, low, span = now, low[:now], span[:now]
            model.keep(live)
        if t in _REBUILDS:
            model.rebuild()
        here = ids[t + 2 : t + 2 + CHUNK, :live]
        contexts = model.contexts(ids[t + 1 : t + 1 + CHUNK, :live], ids[t : t + CHUNK, :live])
        buckets = _BUCKET_OF.take(here, mode="clip")
        entries, start, width = _intervals(model, contexts, here, buckets)
        model.learn(contexts, entries, here, buckets)
        for j in range(CHUNK):
            unit = np.floor(span * (1 / _TOTAL))
            low = low + unit * start[j]
            span = unit * width[j]
            full = np.less(span, _LEAST, out=given[t + j, :live])
            word = np.floor(low * (1 / _LEAST))
            word *= full
            words[t + j, :live] = word
            factor = full * (_WORD - 1)
            factor += 1
            low -= word * _LEAST
            low *= factor
            span *= factor
    ends[:live] = low
    for j in range(2):
        words[steps + j] = word = np.floor(ends * (1 / _LEAST))
        ends = (ends - word * _LEAST) * _WORD
    given[steps:] = True
    stream = words.T[given.T]
    while len(over := np.flatnonzero(stream >= 1 << 24)):
        stream[over] &= (1 << 24) - 1
        stream[over - 1] += 1
    data = stream.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    cuts = np.concatenate(([0], 3 * np.cumsum(given.sum(axis=0)))).tolist()
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def _find(model: Model, guesses: np.ndarray, second: np.ndarray, both: np.ndarray, unit: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id in whose interval a value falls, and the interval's start and width."""
    rest = value - both
    k = np.flatnonzero(rest < 0)
    rest[k] = 0
    slot = np.minimum((rest / unit).astype(np.int32), _SLOTS - 1)
    bucket = model.slots.take(slot + model.by_slot, mode="clip")
    packed = model.packed.take(bucket + model.by_bucket, mode="clip")
    width = ((packed & 2047) * unit) >> _WIDTH_BITS.take(bucket, mode="clip")
    low = (packed >> 11) * unit
    offset = ((rest - low) / width).astype(np.int32)
    ids = _STARTS.take(bucket, mode="clip") + offset
    start = both + low + offset * width
    if len(k):
        share, upto = second[k], both[k]
        two = value[k] < share
        ids[k], start[k], width[k] = np.where(two, guesses[0, k], guesses[1, k]), np.where(two, 0, share), np.where(two, share, upto - share)
    return ids, start, width


def _decode(payloads: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
    n = len(payloads)
    steps = -(-int(lengths.max()) // CHUNK) * CHUNK
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 3)
    data = np.zeros((len(raw) + 4, 4), np.uint8)
    data[: len(raw), :3] = raw
    data = data.view("<u4").ravel()
    at = np.cumsum([0] + [len(p) // 3 for p in payloads])[:-1]
    code, at = data[at] * _WORD + data[at + 1], at + 2
    model, ids = Model(n, finding=True), np.zeros((steps + 2, n), np.int32)
    span, live = np.full(n, _RANGE), n
    for t in range(0, steps, CHUNK):
        if (now := _active(lengths, t)) < live:
            live, code, span, at = now, code[:now], span[:now], at[:now].copy()
            model.keep(live)
        if t in _REBUILDS:
            model.rebuild()
        contexts, entries = np.empty((2, CHUNK, live), np.int64), np.empty((2, CHUNK, live), np.int32)
        for j in range(CHUNK):
            here = model.contexts(ids[t + j + 1, :live], ids[t + j, :live])
            found, guesses, second, both, unit = model.predict(here)
            contexts[:, j], entries[:, j] = here, found
            step = np.floor(span * (1 / _TOTAL))
            value = np.minimum(code / step, _TOTAL - 1).astype(np.int32)
            ids[t + j + 2, :live], start, width = _find(model, guesses, second, both, unit, value)
            code = code - step * start
            span = step * width
            full = span < _LEAST
            factor = full * (_WORD - 1)
            factor += 1
            code *= factor
            code += full * data.take(at, mode="clip")
            span *= factor
            at += full
        here = ids[t + 2 : t + 2 + CHUNK, :live]
        model.learn(contexts, entries, here, _BUCKET_OF.take(here, mode="clip"))
    by_block = ids[2:].T.astype(np.uint16)
    return [by_block[k, : lengths[k]] for k in range(n)]


def _by_length(lengths: list[int]):
    """Groups of block numbers, longest first, each of at most LANES."""
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    return [order[k : k + LANES] for k in range(0, len(order), LANES)]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids (uint16, 1 to BLOCK_IDS of them) as a header with checksums and its coded ids."""
    out: list[bytes] = [b""] * len(blocks)
    for group in _by_length([len(b) for b in blocks]):
        for k, payload in zip(group, _encode([blocks[k] for k in group]), strict=True):
            ids = blocks[k].astype("<u2").tobytes()
            out[k] = HEADER.pack(MAGIC, len(blocks[k]), len(payload), zlib.crc32(ids), zlib.crc32(payload)) + payload
    return out


def split_blocks(data: bytes) -> list[tuple[int, int, bytes]]:
    """(ids, crc32 of the ids, payload) of the blocks that stand one after another."""
    out, at = [], 0
    while at < len(data):
        magic, n, size, ids_crc, crc = HEADER.unpack_from(data, at)
        payload = data[at + HEADER.size : at + HEADER.size + size]
        if magic != MAGIC or len(payload) != size or zlib.crc32(payload) != crc:
            raise ValueError(f"damaged block at byte {at}")
        out.append((n, ids_crc, payload))
        at += HEADER.size + size
    return out


def decode_blocks(blocks: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """The ids of each block, checked against its checksum."""
    out: list[np.ndarray] = [np.empty(0, np.uint16)] * len(blocks)
    for group in _by_length([b[0] for b in blocks]):
        lengths = np.array([blocks[k][0] for k in group])
        for k, ids in zip(group, _decode([blocks[k][2] for k in group], lengths), strict=True):
            if zlib.crc32(ids.astype("<u2").tobytes()) != blocks[k][1]:
                raise ValueError(f"block {k}: ids do not match their checksum")
            out[k] = ids
    return out
