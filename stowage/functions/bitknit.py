"""The sections' entropy codec: matches and literals under adaptive models, two interleaved range states (rANS).

Written from the published description of the format. Output comes in quanta of 64 KiB, each plain or coded; models and
recent offsets live through all of them. An encoder for the coded form is here for round trips.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from ..sources.formats import Malformed, need

#: The magic, probability bits, symbols between adaptions, a state's floor, the output quantum.
MAGIC, BITS, EVERY, FLOOR, QUANTUM = 0x75B1, 15, 1024, 1 << 16, 1 << 16
#: Fixed values: (symbols, symbols of least probability at the end) of commands, recent offsets and offset lengths.
COMMANDS, RECENT, LENGTHS = (300, 36), (40, 0), (21, 0)
#: The first match command, the first with extra bits, and what a short command's length is less by.
MATCH, LONG, SHORT = 256, 288, 254


class Model:
    """Cumulated frequencies that move half-way to what was seen, every EVERY symbols."""

    def __init__(self, size: int, rare: int):
        common, self.size = size - rare, size
        total = 1 << BITS
        self.sums = [(total - rare) * k // common for k in range(common)] + [total - size + k for k in range(common, size + 1)]
        self.step = (total - size) // EVERY
        self.last = 1 + total - size - self.step * EVERY
        self.seen, self.count = [1] * size, 0

    def span(self, symbol: int) -> tuple[int, int]:
        """(sum below, frequency)."""
        return self.sums[symbol], self.sums[symbol + 1] - self.sums[symbol]

    def symbol(self, code: int) -> int:
        return bisect_right(self.sums, code) - 1

    def observe(self, symbol: int) -> None:
        self.seen[symbol] += self.step
        self.count += 1
        if self.count == EVERY:
            self.seen[symbol] += self.last
            # the difference is halved without a sign, in 32 bits, and kept in 16
            self.sums[1:] = [old + ((new - old & 0xFFFFFFFF) >> 1) & 0xFFFF for old, new in zip(self.sums[1:], accumulate(self.seen), strict=True)]
            self.seen, self.count = [1] * self.size, 0


class Offsets:
    """The eight last offsets, the most recent first; a new one takes the seventh's place and that one the eighth's."""

    def __init__(self):
        self.held = [1] * 8

    def hit(self, k: int) -> int:
        self.held.insert(0, self.held.pop(k))
        return self.held[0]

    def insert(self, offset: int) -> None:
        self.held[7] = self.held[6]
        self.held[6] = offset


class Words:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self) -> int:
        need(self.at + 2 <= len(self.data), "the coded section ends early")
        return int.from_bytes(self.data[self.at : self.at + 2], "little")

    def pop(self) -> int:
        out = self.peek()
        self.at += 2
        return out

    def fill(self, state: int) -> int:
        return state << 16 | self.pop() if state < FLOOR else state


class Models:
    def __init__(self):
        self.commands = [Model(*COMMANDS) for _ in range(4)]
        self.recent = [Model(*RECENT) for _ in range(4)]
        self.lengths, self.offsets, self.back = Model(*LENGTHS), Offsets(), 1


class States:
    """Two states that take turns."""

    def __init__(self, words: Words):
        self.words = words
        both = words.pop() << 16 | words.pop()
        split = both & 15
        both = words.fill(both >> 4)
        first = words.fill(both >> split)
        guard = 1 << 16 + split
        self.now, self.other = first, (both << 16 | words.pop()) & guard - 1 | guard

    def turn(self, state: int) -> None:
        self.now, self.other = self.other, self.words.fill(state)

    def bits(self, n: int) -> int:
        out = self.now & (1 << n) - 1
        self.turn(self.now >> n)
        return out

    def pop(self, model: Model) -> int:
        code = self.now & (1 << BITS) - 1
        out = model.symbol(code)
        need(out < model.size, "a code lies outside its model")
        below, frequency = model.span(out)
        self.turn((self.now >> BITS) * frequency + code - below & 0xFFFFFFFF)
        model.observe(out)
        return out


def decode(data: bytes, size: int, most: int = 512 << 20) -> bytes:
    """The plain bytes of a section of known size."""
    need(0 <= size <= most, "a section is too large")
    words, m, out = Words(data), Models(), bytearray()
    need(words.pop() == MAGIC, "a coded section's magic")
    while len(out) < size:
        end = min(size, len(out) // QUANTUM * QUANTUM + QUANTUM)
        if words.peek() == 0:
            start = words.at + 2
            need(start + end - len(out) <= len(data), "a plain quantum is cut off")
            words.at = start + end - len(out)
            out += data[start : words.at]
            continue
        s = States(words)
        if not out:
            out.append(s.bits(8))
        while len(out) < end:
            place = len(out)
            command = s.pop(m.commands[place & 3])
            if command < MATCH:
                out.append(command + (out[place - m.back] if m.back <= place else 0) & 0xFF)
                continue
            length = command - SHORT
            if command >= LONG:
                extra = command - LONG + 1
                length = (1 << extra) + s.bits(extra) + 32
            recent = s.pop(m.recent[place & 3])
            if recent < 8:
                offset = m.offsets.hit(recent)
            else:
                n = s.pop(m.lengths)
                high = s.bits(n & 15)
                if n >= 16:
                    high = high << 16 | words.pop()
                offset = (32 << n) + (high << 5) - 32 + recent - 7
                m.offsets.insert(offset)
            need(0 < offset <= place and length <= size - place, "a match lies outside")
            m.back = offset
            part = out[place - offset : place - offset + length]
            out += (part * (-(-length // len(part))))[:length]
        need(s.now == s.other == FLOOR, "the coder's states don't end where they began")
    return bytes(out)


def _coded(ops: list[tuple[int, int] | tuple[int, int, int]]) -> bytes | None:
    """The words for one quantum's operations, (bits, value) or (below, frequency, 0); None if its first word can't be told
    from a plain quantum's."""
    states, words = [FLOOR, FLOOR], []
    for k in reversed(range(len(ops))):
        x, op = states[k & 1], ops[k]
        if len(op) == 2:
            n, value = op
            if x >> 32 - n:
                words.append(x & 0xFFFF)
                x >>= 16
            x = x << n | value
        else:
            below, frequency, _ = op
            if x >= frequency << 17:
                words.append(x & 0xFFFF)
                x >>= 16
            x = (x // frequency << BITS) + x % frequency + below
        states[k & 1] = x
    first, second = states
    split = second.bit_length() - 17
    both = first >> 16 << split | (second >> 16) - (1 << split)
    if both < FLOOR:
        return None
    head = [first & 0xFFFF, second & 0xFFFF]
    if both >> 28:
        head.insert(0, both & 0xFFFF)
        both >>= 16
    both = both << 4 | split
    return b"".join(w.to_bytes(2, "little") for w in (both >> 16, both & 0xFFFF, *head, *reversed(words)))


def encode(data: bytes) -> bytes:
    """A section that decode() reads back; greedy matches of four bytes and more, quanta apart."""
    import copy

    out, m, at = MAGIC.to_bytes(2, "little"), Models(), 0
    while at < len(data):
        end, ops, kept, start, table = min(len(data), at // QUANTUM * QUANTUM + QUANTUM), [], copy.deepcopy(m), at, {}

        def symbol(model: Model, value: int, ops: list = ops) -> None:
            ops.append((*model.span(value), 0))
            model.observe(value)

        for k in range(max(0, at - QUANTUM), at):
            table[data[k : k + 4]] = k
        if at == 0:
            ops.append((8, data[0]))
            table[data[:4]] = 0
            at = 1
        while at < end:
            length, before = 0, table.get(data[at : at + 4])
            if before is not None and at + 4 <= end:
                while at + length < end and data[before + length] == data[at + length] and length < 2000:
                    length += 1
            table[data[at : at + 4]] = at
            if length < 4:
                symbol(m.commands[at & 3], data[at] - (data[at - m.back] if m.back <= at else 0) & 0xFF)
                at += 1
                continue
            if length < 34:
                symbol(m.commands[at & 3], length + SHORT)
            else:
                extra = (length - 32).bit_length() - 1
                if not extra:
                    length, extra = 33, 0
                    symbol(m.commands[at & 3], 33 + SHORT)
                else:
                    symbol(m.commands[at & 3], LONG - 1 + extra)
                    ops.append((extra, length - 32 - (1 << extra)))
            offset = at - before
            if offset in m.offsets.held:
                k = m.offsets.held.index(offset)
                symbol(m.recent[at & 3], k)
                m.offsets.hit(k)
            else:
                low, n = (offset - 1) % 32, (offset - 1 + 32 >> 5).bit_length() - 1
                symbol(m.recent[at & 3], low + 8)
                symbol(m.lengths, n)
                ops.append((n & 15, (offset - 1 - low + 32 - (32 << n)) >> 5))
                m.offsets.insert(offset)
            m.back = offset
            at += length
        coded = _coded(ops)
        if coded is None:
            m = kept
            coded = b"\0\0" + data[start:end]
            at = end
        out += coded
    return out


def check(data: bytes, size: int) -> bytes | None:
    """decode(), or None where the data is broken."""
    try:
        return decode(data, size)
    except Malformed:
        return None
