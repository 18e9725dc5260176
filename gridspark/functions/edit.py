"""Edit distances of many texts at once: the bit-parallel recurrence of Myers in Hyyrö's banded form.

A column of the distance table is held as the signs of its vertical steps, one bit a row, and only the
rows within the cap of the diagonal matter. Up to a cap of WIDEST they fit one 64-bit word, whatever
the length of the texts. The highest bit stands for the row `cap` below the diagonal, where the distance
is followed: down the diagonal to the last row, then along it. A step takes one character of every query
of a tile against all texts of the tile, some twenty operations on arrays of words.

Grids of one shape meet in `Grids` first: sums over their rows, taken from a table, bound the distance
from below, and only pairs that the bound leaves are stepped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The largest cap whose band of 2 * cap + 1 rows fits a word, with a bit to spare.
WIDEST = 31
#: Pairs that step together, and bytes of the match words of a tile's texts.
PAIRS, BYTES = 16_384, 32_000_000
#: Steps between looks at which pairs can still come under their limit.
LOOK = 8
#: Parts of an edit in which the bound by rows counts; largest grids it takes, so that its sums fit a byte.
UNIT, MOST_HIGH, MOST_WIDE = 6, 16, 12
#: Entries of the tables of row costs of a shape, and how many are filled at a time; texts and queries whose bounds are summed at a time.
COSTS, CELLS, TEXTS, QUERIES = 1 << 27, 1 << 16, 256, 1024
NEWLINE = 10
U64 = np.uint64
ONE, TOP = U64(1), U64(63)


def code_points(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the texts and their code points as a matrix, by length."""
    sizes = np.array([len(t) for t in texts], np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        rows = np.array([texts[i] for i in at], f"<U{max(1, size)}").view(np.uint32).reshape(len(at), -1)[:, :size]
        yield at, rows


def letters_of(rows: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Places of characters in a sorted alphabet; its length for those that it lacks."""
    at = np.searchsorted(alphabet, rows)
    known = at < len(alphabet)
    known[known] = alphabet[at[known]] == rows[known]
    return np.where(known, at, len(alphabet))


class Tile:
    """Texts of one length, ready to be stepped through: for each character the rows where it stands, in words of 64 bits with an empty one in front."""

    def __init__(self, rows: np.ndarray, cap: int, alphabet: np.ndarray | None = None):
        n, self.size = rows.shape
        self.cap, self.n = cap, n
        self.alphabet = np.unique(rows) if alphabet is None else alphabet
        self.match = np.zeros((1 + (self.size + 2 * cap) // 64 + 2, len(self.alphabet) + 1, n), U64)
        codes, every = np.searchsorted(self.alphabet, rows), np.arange(n)
        for i in range(self.size):
            self.match[1 + i // 64][codes[:, i], every] |= ONE << U64(i % 64)

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """The characters of queries; one that no text has comes last and matches nowhere."""
        return letters_of(rows, self.alphabet)

    def window(self, step: int, pick) -> np.ndarray:
        """For a step from 1 on, the 64 rows up to `cap` below it of what `pick` takes from each word."""
        word, off = divmod(step + self.cap, 64)
        x = pick(self.match[word])
        if off:
            x >>= U64(off)
            x |= pick(self.match[word + 1]) << U64(64 - off)
        return x


def stepped(x: np.ndarray, up: np.ndarray, down: np.ndarray, one=ONE) -> tuple[np.ndarray, ...]:
    """One column on: which diagonals stay, horizontal steps up and down, next vertical steps up and down."""
    stay = x & up
    stay += up
    stay ^= up
    stay |= x
    stay |= down
    right_up = stay | up
    np.invert(right_up, out=right_up)
    right_up |= down
    right_down = stay & up
    low = stay >> one
    next_up = low | right_up
    np.invert(next_up, out=next_up)
    next_up |= right_down
    low &= right_up
    return stay, right_up, right_down, next_up, low


def least(tile: Tile, queries: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Of each query (code points, all of one length) the least distance to a text of the tile, if it is up to the query's limit; limit + 1 else.

    limit is up to the cap. Along the diagonal distances don't fall, and along the last row they fall by
    one a step at most, so a pair ends early once it can't come under its limit.
    """
    cap, size, (n, length) = tile.cap, tile.size, queries.shape
    out = limit + 1
    if abs(size - length) > cap or not n or not tile.n:
        return out
    codes = tile.codes(queries)
    turn = max(0, size - cap)
    up = np.full((n, tile.n), U64(2**64 - 1) << U64(63 - cap))
    down, far = np.zeros_like(up), np.full(up.shape, min(cap, size), np.int32)
    # Of each pair that is left, once few are: its query and text.
    query, text = None, None
    most = limit[:, None]
    for step in range(1, length + 1):
        char = codes[:, step - 1]
        if query is None:
            x = tile.window(step, lambda word, c=char: word[c])
        else:
            x = tile.window(step, lambda word, c=char[query]: word[c, text])
        stay, right_up, right_down, up, down = stepped(x, up, down)
        if step <= turn:
            far += (stay >> TOP) == 0
        else:
            at = U64(63 - (step + cap - size))
            far += ((right_up >> at) & ONE).astype(np.int32)
            far -= ((right_down >> at) & ONE).astype(np.int32)
        if step % LOOK == 0 and step < length:
            alive = far <= most + (length - max(step, turn))
            share = alive.mean()
            if not share:
                return out
            if share < 0.1 or (query is not None and share < 0.7):
                if query is None:
                    query, text = np.nonzero(alive)
                else:
                    query, text = query[alive], text[alive]
                up, down, far, most = up[alive], down[alive], far[alive], limit[query]
    if query is None:
        return np.minimum(out, far.min(axis=1))
    np.minimum.at(out, query, far.astype(out.dtype))
    return out


class Limits:
    """The least distances found so far of queries, of which some ask for their own and the rest only for the least of their group."""

    def __init__(self, n: int, cap: int, group: np.ndarray | None, own: np.ndarray | None, start: np.ndarray | None):
        self.best = np.full(n, cap + 1, np.int64) if start is None else start.astype(np.int64)
        self.group = np.arange(n) if group is None else group
        self.own = np.ones(n, bool) if own is None else own
        self.least = np.full(int(self.group.max(initial=-1)) + 1, cap + 1, np.int64)
        np.minimum.at(self.least, self.group, self.best)

    def of(self, at: np.ndarray) -> np.ndarray:
        """The largest distances of queries that would still count; -1 where none would."""
        return np.where(self.own[at], self.best[at], self.least[self.group[at]]) - 1

    def found(self, at: np.ndarray, d: np.ndarray) -> None:
        np.minimum.at(self.best, at, d)
        np.minimum.at(self.least, self.group[at], d)


def grid_shapes(rows: np.ndarray, cap: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Height, width and places of those texts of one length that are grids which the bound by rows can take."""
    size = rows.shape[1]
    if not size:
        return
    ends = rows == NEWLINE
    width = np.where(ends.any(axis=1), ends.argmax(axis=1), 0)
    for w in np.unique(width[(width >= max(1, cap // 2)) & (width <= MOST_WIDE)]).tolist():
        h, odd = divmod(size + 1, w + 1)
        if odd or h > MOST_HIGH:
            continue
        due = np.arange(1, size + 1) % (w + 1) == 0
        at = np.flatnonzero((width == w) & (ends == due).all(axis=1))
        if len(at):
            yield h, w, at


def coded_rows(rows: np.ndarray, h: int, w: int, letters: tuple[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each of the h rows the distinct ones of all grids, as codes 0, 1 (the letters) and 2 (any other), and the number of each grid's row among them."""
    codes = np.full(rows.shape, 2, np.uint8)
    for k, x in enumerate(letters):
        codes[rows == x] = k
    out = []
    for start in range(0, h * (w + 1), w + 1):
        number = np.zeros(len(rows), np.int64)
        for k in range(start, start + w):
            number *= 3
            number += codes[:, k]
        seen = np.zeros(3**w, bool)
        seen[number] = True
        kinds = np.flatnonzero(seen)[:, None] // 3 ** np.arange(w - 1, -1, -1) % 3
        out.append((kinds.astype(np.uint8), (np.cumsum(seen) - 1)[number]))
    return out


def prices(r: int, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """What coming in to row r at offsets of 0 to w costs and what going out does, see row_costs."""
    off, slope = np.arange(w + 1), lambda r: max(-UNIT, min(UNIT, h // 2 - r))
    both = UNIT * np.maximum(2, np.abs(off[:, None] - off) + 1)
    come = np.where(off, (both + (off * slope(r) - UNIT)[:, None])[1:].min(axis=0), 0)
    go = np.where(off, UNIT - off * slope(r + 1), 0)
    # Grids begin and end without an offset: other ways are no cheaper than those along the sides.
    return UNIT * off if r == 0 else come, UNIT * off if r == h - 1 else go


def row_costs(a: np.ndarray, b: np.ndarray, r: int, h: int, most: int) -> np.ndarray:
    """For rows a of queries and b of texts, at place r of h, what a pair adds to the bound, in parts 1 / UNIT of an edit, `most` at most.

    Take two grids of h rows of w tiles and a cheapest path of edits, and let its offset be its place in the text less that in
    the query. If it has up to 2 * w + 1 edits its offset is w at most, so the new line after a row can match only the one
    after the same row of the other, and it does unless the path avoids it, with an offset on its one side (where the
    first of the two new lines is reached) and an offset of the same sign on its other side (where both are passed).
    Then each of the two new lines takes an edit of its own, and from an offset x to an offset y it takes |x - y| + 1 edits at least.
    Within a row the path comes in at an offset and goes out at an offset, and its cheapest way from the one side of
    the table of the two rows to the other is counted.

    A far offset leaves little of two rows to compare, but takes many edits to get to and back from. So offsets have a
    price: where the path goes out of row r at an offset, UNIT is added and |offset| * slope(r + 1) taken off, and in front of
    the next row the same the other way round; over a path the prices cancel. Slopes fall by rows, from above 0 to below.
    """
    (n, w), m = a.shape, len(b)
    out = np.empty((n, m), np.uint8)
    come, go = prices(r, h, w)
    low = -min(int(come.min()), int(go.min()))
    kind = np.uint8 if low + UNIT * w + max(int(come.max()), int(go.max())) < 256 else np.int16
    unlike = (np.arange(3)[:, None, None] != b.T[None]).astype(kind) * kind(UNIT)
    come, go, unit = (come + low).astype(kind), go.astype(kind), kind(UNIT)
    per = max(1, CELLS // max(1, m))
    for lo in range(0, n, per):
        rows = a[lo : lo + per]
        column = [np.full((len(rows), m), x, kind) for x in come]
        for j in range(1, w + 1):
            np.minimum(column[j], column[j - 1] + unit, out=column[j])
        best = column[w] + go[w]
        for i in range(1, w + 1):
            before = column[0]
            column[0] = np.minimum(before + unit, come[i])
            for j in range(1, w + 1):
                step = np.minimum(column[j], column[j - 1])
                step += unit
                change = unlike[:, j - 1].take(rows[:, i - 1], axis=0)
                change += before
                before = column[j]
                column[j] = np.minimum(step, change, out=step)
            np.minimum(best, column[w] + go[w - i], out=best)
        for j in range(w + 1):
            np.minimum(best, column[j] + go[w - j], out=best)
        out[lo : lo + per] = np.minimum(best - kind(low), kind(most))
    return out


class Grids:
    """Queries that are grids of one shape, in number `at` of all queries, to meet texts of that shape."""

    def __init__(self, at: np.ndarray, rows: np.ndarray, h: int, w: int, cap: int):
        self.at, self.rows, self.h, self.w, self.cap = at, rows, h, w, cap
        seen, counts = np.unique(rows, return_counts=True)
        often = [int(x) for x in seen[np.argsort(-counts)] if x != NEWLINE]
        self.letters = (*often, -1, -1)[:2]
        self.kinds = coded_rows(rows, h, w, self.letters)

    def meet(self, texts: np.ndarray, limits: Limits) -> None:
        """Looks for the least distances to the texts (code points), all of them of this shape."""
        theirs = coded_rows(texts, self.h, self.w, self.letters)
        if sum(len(a) * len(b) for (a, _), (b, _) in zip(self.kinds, theirs, strict=True)) > COSTS and len(texts) > 1:
            for part in np.array_split(texts, 2):
                self.meet(part, limits)
            return
        # A row that is the same in all adds nothing.
        places = [r for r, ((a, _), (b, _)) in enumerate(zip(self.kinds, theirs, strict=True)) if len(a) > 1 or len(b) > 1 or (a != b).any()]
        costs = [row_costs(self.kinds[r][0], theirs[r][0], r, self.h, 255 // len(places)) for r in places]
        # What all texts and queries begin or end with leaves distances as they are.
        like = (texts == texts[:1]).all(axis=0) & (self.rows == texts[:1]).all(axis=0)
        first = int(np.argmin(like)) if not like.all() else len(like)
        last = max(first, len(like) - (int(np.argmin(like[::-1])) if not like.all() else 0))
        alphabet = np.unique(texts)
        codes = np.ascontiguousarray(letters_of(self.rows[:, first:last], alphabet).astype(np.min_scalar_type(len(alphabet))).T)
        row = np.empty((QUERIES, TEXTS), np.uint8)
        for lo in range(0, len(texts), TEXTS):
            steps = Steps(Tile(texts[lo : lo + TEXTS, first:last], self.cap // 2, alphabet), codes)
            n = steps.tile.n
            by_place = [cost.take(theirs[r][1][lo : lo + TEXTS], axis=1) for r, cost in zip(places, costs, strict=True)]
            left, held = [], 0
            for q in range(0, len(self.at), QUERIES):
                part = slice(q, q + QUERIES)
                limit = limits.of(self.at[part])
                total = np.zeros((len(limit), n), np.uint8)
                for r, cost in zip(places, by_place, strict=True):
                    total += cost.take(self.kinds[r][1][part], axis=0, out=row[: len(limit), :n] if n == TEXTS else None, mode="clip")
                under = total <= np.clip(limit * UNIT, 0, 255).astype(np.uint8)[:, None]
                under[limit < 0] = False
                pairs = np.flatnonzero(under)
                left.append((pairs // n + q, pairs % n, total.ravel()[pairs]))
                held += len(pairs)
                if held >= PAIRS or q + QUERIES >= len(self.at):
                    self.settle(steps, *(np.concatenate(x) for x in zip(*left, strict=True)), limits)
                    left, held = [], 0

    def settle(self, steps: Steps, query: np.ndarray, text: np.ndarray, bound: np.ndarray, limits: Limits) -> None:
        """The distances of the pairs that the bound leaves, lowest bounds first."""
        order = np.argsort(bound, kind="stable")
        for lo in range(0, len(order), PAIRS):
            part = order[lo : lo + PAIRS]
            limit = limits.of(self.at[query[part]])
            part = part[bound[part] <= limit * UNIT]
            if len(part):
                limit = limits.of(self.at[query[part]])
                near, d = steps.within(query[part], text[part], limit)
                limits.found(self.at[query[part][near]], d)


class Steps:
    """Texts of a tile and queries of the same length (letters by step), ready for pairs to be stepped within half a word: the tile's cap is half the largest limit, as offsets of as many edits go that far and back."""

    def __init__(self, tile: Tile, codes: np.ndarray):
        self.tile, self.codes, self.windows = tile, codes, {}

    def window(self, step: int) -> np.ndarray:
        if step not in self.windows:
            self.windows[step] = (self.tile.window(step, lambda word: word.copy()) >> U64(32)).astype(np.uint32).ravel()
        return self.windows[step]

    def within(self, query: np.ndarray, text: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs are up to their limits apart (2 * cap + 1 at most), and how far."""
        size, cap, one = self.tile.size, self.tile.cap, np.uint32(1)
        turn, at = max(0, size - cap), np.arange(len(query))
        up = np.full(len(query), (0xFFFFFFFF << (31 - cap)) & 0xFFFFFFFF, np.uint32)
        down, far = np.zeros_like(up), np.full(len(query), min(cap, size), np.int32)
        most = limit.astype(np.int32)
        for step in range(1, size + 1):
            place = np.multiply(self.codes[step - 1].take(query), self.tile.n, dtype=np.intp)
            place += text
            stay, right_up, right_down, up, down = stepped(self.window(step).take(place), up, down, one)
            if step <= turn:
                far += (stay >> np.uint32(31)) == 0
            else:
                shift = np.uint32(31 - (step + cap - size))
                far += ((right_up >> shift) & one).astype(np.int32)
                far -= ((right_down >> shift) & one).astype(np.int32)
            if step % LOOK == 0 and step < size:
                alive = far <= most + (size - max(step, turn))
                if alive.mean() < 0.8:
                    at, query, text, up, down, far, most = (x[alive] for x in (at, query, text, up, down, far, most))
                if not len(at):
                    break
        near = far <= most
        return at[near], far[near].astype(np.int64)


def nearest(texts: Iterator[list[str]], queries: list[str], cap: int, mark: str, group: np.ndarray | None = None, own: np.ndarray | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """The least distance of each query to any of the texts, cap + 1 where none is within the cap (up to WIDEST).

    What has been found so far is the limit of what comes next; `start` has least distances that are known before. With groups of
    queries, only those of `own` have their own least distance, the others no more than what the least of their group takes.
    The numbers of `mark` in two texts differ by no more than their distance, so both are taken in order of that
    number and far ones don't meet; grids of one shape meet by rows.
    """
    limits = Limits(len(queries), cap, group, own, start)
    asked, grids = [], {}
    for at, rows in code_points(queries):
        marks = (rows == ord(mark)).sum(axis=1)
        order = np.argsort(marks, kind="stable")
        asked.append((at[order], rows[order], marks[order]))
        for h, w, part in grid_shapes(rows, cap):
            grids[h, w] = Grids(at[part], rows[part], h, w, cap)
    for batch in texts:
        for _, rows in code_points(batch):
            shapes, size = {}, rows.shape[1]
            for h, w, part in grid_shapes(rows, cap):
                if (h, w) in grids:
                    grids[h, w].meet(rows[part], limits)
                    shapes[h, w] = part
            met = {shape: np.isin(np.arange(len(rows)), part) for shape, part in shapes.items()}
            marks = (rows == ord(mark)).sum(axis=1)
            # Queries of a shape that has met here only meet the other texts.
            for at, mine, theirs in asked:
                if abs(mine.shape[1] - size) > cap:
                    continue
                rest = np.ones(len(at), bool)
                if mine.shape[1] == size:
                    for shape, there in met.items():
                        of = np.isin(at, grids[shape].at)
                        rest &= ~of
                        stepwise(rows[~there], marks[~there], at[of], mine[of], theirs[of], cap, limits)
                stepwise(rows, marks, at[rest], mine[rest], theirs[rest], cap, limits)
    return limits.best


def stepwise(rows: np.ndarray, marks: np.ndarray, at: np.ndarray, mine: np.ndarray, theirs: np.ndarray, cap: int, limits: Limits) -> None:
    """Steps the queries (code points `mine` in order of their marks `theirs`) against all texts of one length."""
    if not len(rows) or not len(at):
        return
    order = np.argsort(marks, kind="stable")
    rows, marks = rows[order], marks[order]
    words = 1 + (rows.shape[1] + 2 * cap) // 64 + 2
    per = max(1, min(PAIRS, BYTES // (8 * words * (len(np.unique(rows)) + 1))))
    for lo in range(0, len(rows), per):
        tile, own = Tile(rows[lo : lo + per], cap), marks[lo : lo + per]
        many = max(1, PAIRS // tile.n)
        reach = np.flatnonzero((theirs >= own[0] - cap) & (theirs <= own[-1] + cap) & (limits.of(at) >= 0))
        for k in range(0, len(reach), many):
            part = reach[k : k + many]
            limit = limits.of(at[part])
            d = least(tile, mine[part], limit)
            limits.found(at[part][d <= limit], d[d <= limit])
