"""Which titles are alike, and what articles of such titles make of each other: numpy on blocks of rows, called from Arrow functions.

Nothing here is cut: a block of titles is compared with every title of the other, by shared trigrams, then by a bound on the
matching-blocks similarity (the longest common subsequence, as bits), and only what may reach the threshold is compared in full.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np

#: Letters of the shorter title that one machine word of the bound holds; longer ones are bounded by Python's integers.
WORD = 64
#: Rows that are expanded at a time; a trigram that more than one in so many titles have is counted by rows.
ROWS, OFTEN = 1 << 20, 100


def ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, start, start + 1 and so on, count of them: which row, and the number."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + start[row]


def chunks(count: np.ndarray, most: int = ROWS) -> Iterator[slice]:
    """Slices of rows whose counts add up to about `most`, one row at least."""
    upto, at = np.cumsum(count), 0
    while at < len(count):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield slice(at, end)
        at = end


class Titles:
    """Distinct titles as letters, trigrams and masks."""

    def __init__(self, keys: list[str], letters: np.ndarray):
        """letters: sorted code points of all titles that will be compared with each other."""
        self.keys, self.letters = keys, letters
        self.n = np.array([len(k) for k in keys], dtype=np.int64)
        text = np.searchsorted(letters, np.frombuffer("".join(keys).encode("utf-32-le"), dtype=np.uint32))
        own, at = ranges(np.zeros(len(keys), dtype=np.int64), self.n)
        ok = np.flatnonzero(at + 2 < self.n[own])
        self.base = len(letters)
        gram = (text[ok] * self.base + text[ok + 1]) * self.base + text[ok + 2]
        order = np.lexsort((gram, own[ok]))
        title, gram = own[ok][order], gram[order]
        new = np.ones(len(gram), dtype=bool)
        new[1:] = (title[1:] != title[:-1]) | (gram[1:] != gram[:-1])
        self.title, self.gram = title[new], gram[new]
        self.size = np.bincount(self.title, minlength=len(keys))
        self.first = np.searchsorted(self.title, np.arange(len(keys) + 1))
        # letters by place, and for each letter the places that have it
        short = np.minimum(self.n, 2 * WORD)
        self.codes = np.full((len(keys), 2 * WORD), self.base, dtype=np.int32)
        near = at < 2 * WORD
        self.codes[own[near], at[near]] = text[near]
        self.width = int(short.max()) if len(keys) else 0

    def masks(self, some: np.ndarray) -> np.ndarray:
        out = np.zeros((len(some), self.base + 1), dtype=np.uint64)
        for p in range(min(WORD, int(self.n[some].max()))):
            out[np.arange(len(some)), self.codes[some, p]] |= np.uint64(1 << p)
        out[:, self.base] = 0
        return out


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    masks: dict[str, int] = {}
    for p, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << p
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        x = v & masks.get(c, 0)
        v = (v + x | v & ~x) & full
    return len(a) - v.bit_count()


def _bounded(a: Titles, b: Titles, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Longest common subsequences of the titles x of a, at most WORD long, and y of b, at most twice as long."""
    some, at = np.unique(x, return_inverse=True)
    if len(some) > 1 and len(some) * a.base > 4 * ROWS:  # many different letters: the masks of fewer titles at a time
        out, low = np.empty(len(x), dtype=np.int64), x < some[len(some) // 2]
        for half in (low, ~low):
            out[half] = _bounded(a, b, x[half], y[half])
        return out
    masks, v = a.masks(some), np.full(len(x), ~np.uint64(0))
    flat, row, codes = masks.ravel(), at * masks.shape[1], b.codes[y]
    for p in range(int(b.n[y].max())):
        m = v & flat[row + codes[:, p]]
        v = (v + m) | (v & ~m)
    n = a.n[x].astype(np.uint64)
    full = np.where(n < WORD, (np.uint64(1) << (n % np.uint64(WORD))) - np.uint64(1), ~np.uint64(0))
    return np.bitwise_count(~v & full).astype(np.int64)


def alike(left: list[str], right: list[str] | None, shared: float, threshold: float) -> list[tuple[str, str, float]]:
    """(a, b, ratio) of the ordered pairs of titles of left and right, or within left, that have that part of trigrams in common and reach the threshold."""
    letters = np.unique(np.frombuffer("".join([*left, *(right or [])]).encode("utf-32-le"), dtype=np.uint32))
    a = Titles(left, letters)
    b = a if right is None else Titles(right, letters)
    if not len(left) or not len(b.keys):
        return []
    order = np.argsort(b.gram, kind="stable")
    there, first = np.unique(b.gram[order], return_index=True)
    post, ends = b.title[order], np.append(first, len(order))
    spot = np.searchsorted(there, a.gram)
    met = (spot < len(there)) & (there[np.minimum(spot, len(there) - 1)] == a.gram)
    # a trigram that many titles have is a row of zeros and ones, any other a list of titles
    kind = np.uint8 if max(a.size.max(), b.size.max()) < 256 else np.uint32
    common = np.flatnonzero(np.diff(ends) * OFTEN > len(b.keys))
    rows = np.zeros((len(common), len(b.keys)), dtype=kind)
    for r, g in enumerate(common):
        rows[r, post[ends[g] : ends[g + 1]]] = 1
    row_of = np.full(len(there), -1)
    row_of[common] = np.arange(len(common))
    needs: dict[int, np.ndarray] = {}
    out: list[tuple[str, str, float]] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def settle() -> None:
        x, y = (np.concatenate(z) for z in zip(*held, strict=True))
        la, lb = a.n[x], b.n[y]
        most = np.zeros(len(x), dtype=np.int64)
        one, two = la <= np.minimum(lb, WORD), (lb < la) & (lb <= WORD)
        fits = np.maximum(la, lb) <= 2 * WORD
        if (w := np.flatnonzero(one & fits)).size:
            most[w] = _bounded(a, b, x[w], y[w])
        if (w := np.flatnonzero(two & fits)).size:
            most[w] = _bounded(b, a, y[w], x[w])
        for w in np.flatnonzero(~((one | two) & fits)):
            most[w] = _common(a.keys[x[w]], b.keys[y[w]])
        for w in np.flatnonzero(2.0 * most / (la + lb) >= threshold):
            for s, t in ((a.keys[x[w]], b.keys[y[w]]), (b.keys[y[w]], a.keys[x[w]])):  # the ratio depends on the order
                ratio = difflib.SequenceMatcher(None, s, t, autojunk=False).ratio()
                if ratio >= threshold:
                    out.append((s, t, ratio))
        held.clear()

    for i in range(len(left)):
        at = slice(a.first[i], a.first[i + 1])
        grams = spot[at][met[at]]
        if not len(grams):
            continue
        r = row_of[grams]
        n = np.add.reduce(rows[r[r >= 0]], axis=0, dtype=kind)
        lists = [post[ends[g] : ends[g + 1]] for g in grams[r < 0]]
        if lists:
            n += np.bincount(np.concatenate(lists), minlength=len(b.keys)).astype(kind)
        size_a = int(a.size[i])
        if size_a not in needs:
            if len(needs) > 100:
                needs.clear()
            needs[size_a] = np.ceil(shared * np.minimum(size_a, b.size)).astype(kind)
        near = n >= needs[size_a]
        if right is None:
            near[: i + 1] = False
        y = np.flatnonzero(near)
        y = y[2.0 * np.minimum(a.n[i], b.n[y]) / (a.n[i] + b.n[y]) >= threshold]
        if y.size:
            held.append((np.full(y.size, i), y))
            size += y.size
        if size > ROWS >> 4:
            settle()
            size = 0
    if held:
        settle()
    return out


HOUR = 3_600_000_000
#: What a kind of articles is told by: all that guards ask for but the time.
KIND = ["title", "headline", "channel", "event", "companies", "official", "filed", "hkex", "url", "numbers", "move"]


def coded(values: list) -> np.ndarray:
    """A number for each different value (null is one)."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(v, len(seen)) for v in values), dtype=np.int64, count=len(values))


class Articles:
    """Articles in order of time, their kinds, and which kinds are linked.

    Articles of one title that no guard tells apart, but by their time, are one kind. Guards are asked once for a pair of kinds; articles
    are then found by ranges of time, so that copies are not expanded into pairs.
    """

    def __init__(self, rows: dict[str, list], pairs: list[tuple[str, str, float]], hours: int, headline_hours: int, letters: int):
        """rows: id, at (microseconds, not null) and facts; pairs: a, b, ratio of different titles."""
        at, ids = np.array(rows["at"], dtype=np.int64), np.array(rows["id"], dtype=np.int64)
        self.order = np.lexsort((ids, at))
        self.at, self.ids, self.hours, self.headline_hours = at[self.order], ids[self.order], hours, headline_hours
        get = lambda name: [rows[name][i] for i in self.order]
        titles: dict[str, int] = {}
        title = np.array([titles.setdefault(k, len(titles)) if len(k) >= letters else -1 for k in get("key")], dtype=np.int64)
        official = np.array(get("official"), dtype=bool)
        headlines = get("headline")
        headline = np.where(official | (np.array([len(h) for h in headlines], dtype=np.int64) < letters), -1, coded(headlines))
        event = np.where([e in (None, "", "other") for e in get("event_type")], -1, coded(get("event_type")))
        sets = [tuple(sorted(set(c), key=lambda x: (x is None, x))) for c in get("companies")]
        self.sets = list(dict.fromkeys(sets))
        numbers = [tuple(n) for n in get("numbers")]
        urls = get("url")
        columns = [
            title, headline, coded(get("channel")), event, coded(sets), official, [f is not None for f in get("form")], ["hkexnews.hk" in u for u in urls],
            np.where(official, coded(urls), -1), np.where([not n for n in numbers], -1, coded(numbers)), np.where(get("move"), coded(get("day")), -1),
        ]
        kinds, self.kind = np.unique(np.column_stack([np.asarray(c, dtype=np.int64) for c in columns]), axis=0, return_inverse=True)
        self.kind = self.kind.reshape(-1)
        self.k = dict(zip(KIND, kinds.T, strict=True))
        self.kinds, self.shares = len(kinds), {}
        self._link([(titles[a], titles[b], r) for a, b, r in pairs if a in titles and b in titles], len(titles))

    def _shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """1 where two sets of companies have one in common, 0 where not, 2 where a null leaves it open."""
        both, back = np.unique(np.column_stack([x, y]), axis=0, return_inverse=True)
        for i, j in both:
            if (i, j) not in self.shares:
                a, b = set(self.sets[i]), set(self.sets[j])
                self.shares[i, j] = 1 if a & b - {None} else 2 if a and b and None in a | b else 0
        return np.array([self.shares[i, j] for i, j in both], dtype=np.int64)[back.reshape(-1)]

    def guard(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For kinds x and y, times left aside: whether a headline may join them, and whether titles decide."""
        a, b = ({n: v[z] for n, v in self.k.items()} for z in (x, y))
        some = np.array([len(s) > 0 for s in self.sets], dtype=bool)
        shared = self._shared(a["companies"], b["companies"])
        unlike = lambda n: (a[n] >= 0) & (b[n] >= 0) & (a[n] != b[n])
        near = ~unlike("move") & ~(some[a["companies"]] & some[b["companies"]] & (shared == 0))
        head = near & (a["headline"] >= 0) & (a["headline"] == b["headline"])
        filings = (a["official"] & b["official"] & (a["url"] != b["url"]) & (a["filed"] | b["filed"] | a["hkex"] & b["hkex"])) != 0
        return head, near & ~((a["channel"] != b["channel"]) & (shared == 0)) & ~unlike("event") & ~filings & ~unlike("numbers")

    def _link(self, pairs: list[tuple[int, int, float]], n: int) -> None:
        """x, y: kinds whose articles are linked, x's being later; ratio of their titles, or -1; head: whether a headline joins them within its hours."""
        table = np.array([*pairs, *((t, t, 1.0) for t in range(n))], dtype=np.float64).reshape(-1, 3)
        ta, tb, ratio = table[:, 0].astype(np.int64), table[:, 1].astype(np.int64), table[:, 2]
        known = np.sort(ta * n + tb)
        found: list[tuple[np.ndarray, ...]] = []

        def take(x: np.ndarray, y: np.ndarray, score: np.ndarray) -> None:
            head, open_ = self.guard(x, y)
            score = np.where(open_, score, -1.0)
            ok = head | (score >= 0)
            found.append((x[ok], y[ok], score[ok], head[ok]))

        title = self.k["title"]  # kinds are sorted by title
        first, end = np.searchsorted(title, np.arange(n)), np.searchsorted(title, np.arange(n), "right")
        row, x = ranges(first[ta], (end - first)[ta])
        for part in chunks((end - first)[tb[row]]):
            p = row[part]
            r, y = ranges(first[tb[p]], (end - first)[tb[p]])
            take(x[part][r], y, ratio[p][r])
        # equal headlines of titles that are not alike
        by = np.lexsort((title, self.k["headline"]))
        heads = self.k["headline"][by]
        by = by[heads >= 0]
        heads = heads[heads >= 0]
        _, start, count = np.unique(heads, return_index=True, return_counts=True)
        mixed = (title[by][start] != title[by][start + count - 1]) | (title[by][start] < 0)
        row, x = ranges(start[mixed], count[mixed])
        for part in chunks(count[mixed][row]):
            g = row[part]
            r, y = ranges(start[mixed][g], count[mixed][g])
            x1, y1 = by[x[part][r]], by[y]
            spot = title[x1] * n + title[y1]
            new = (title[x1] < 0) | (title[y1] < 0) | ~np.isin(spot, known)
            take(x1[new], y1[new], np.full(int(new.sum()), -1.0))
        self.x, self.y, self.ratio, self.head = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))

    def _since(self, hours: int) -> np.ndarray:
        return np.searchsorted(self.at, self.at - hours * HOUR)

    def _of(self, kind: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Articles by kind and time, and where each kind begins and how many it has."""
        count = np.bincount(kind, minlength=n)
        return np.argsort(kind, kind="stable"), np.cumsum(count) - count, count

    def links(self) -> np.ndarray:
        """For each article how many others it is linked with."""
        m = len(self.at)
        by, first, count = self._of(self.kind, self.kinds)
        place = self.kind[by] * m + by
        since, since_head = self._since(self.hours), self._since(self.headline_hours)
        n, steps = np.zeros(m, dtype=np.int64), np.zeros(m + 1, dtype=np.int64)
        for part in chunks(count[self.x]):
            row, at = ranges(first[self.x[part]], count[self.x[part]])
            i, y = by[at], self.y[part][row]
            low = np.searchsorted(place, y * m + np.where(self.ratio[part][row] >= 0, since[i], since_head[i]))
            high = np.searchsorted(place, y * m + i)
            np.add.at(n, i, high - low)
            np.add.at(steps, low, 1)
            np.add.at(steps, high, -1)
        n[by] += np.cumsum(steps[:-1])
        return n

    def anchors(self) -> np.ndarray:
        """For each article the one that began its story, taken one by one in order of time: the best of the anchors so far, the earliest of equals."""
        order = np.argsort(self.y, kind="stable")
        ends = np.searchsorted(self.y[order], np.arange(self.kinds + 1))
        x, ratio, head = self.x[order].tolist(), self.ratio[order].tolist(), self.head[order].tolist()
        at, kind, ends = self.at.tolist(), self.kind.tolist(), ends.tolist()
        hours, headline_hours = self.hours * HOUR, self.headline_hours * HOUR
        waiting: dict[int, list[tuple[int, int, float, bool]]] = {}
        anchor = list(range(len(at)))
        for i, (t, k) in enumerate(zip(at, kind, strict=True)):
            best, into = -1.0, i
            seen = waiting.get(k)
            if seen:
                if t - seen[0][1] > hours:
                    seen = waiting[k] = [s for s in seen if t - s[1] <= hours]
                for j, since, score, same in seen:
                    if same and t - since <= headline_hours:
                        score = 1.0
                    if score > best:
                        best, into = score, j
            anchor[i] = into
            if into == i:
                for e in range(ends[k], ends[k + 1]):
                    waiting.setdefault(x[e], []).append((i, t, ratio[e], head[e]))
        return np.array(anchor, dtype=np.int64)

    def merged(self, anchor: np.ndarray, least: int, rounds: int) -> np.ndarray:
        """The story of each article after stories that at least so many pairs of articles link have become one, unless a guard keeps their anchors apart."""
        m = len(self.at)
        part_of, which = np.unique(self.kind * m + anchor, return_inverse=True)  # articles of one kind and story
        by, first, count = self._of(self.kind, self.kinds)
        inner = np.argsort(which, kind="stable")
        place = which[inner] * m + inner
        starts = np.searchsorted(part_of, np.arange(self.kinds) * m)
        parts = np.searchsorted(part_of, (np.arange(self.kinds) + 1) * m) - starts
        since, since_head = self._since(self.hours), self._since(self.headline_hours)
        codes, ns, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for some in chunks(count[self.x] * parts[self.y]):
            row, at = ranges(first[self.x[some]], count[self.x[some]])
            again, part = ranges(starts[self.y[some][row]], parts[self.y[some][row]])
            row, i = row[again], by[at[again]]
            other = part_of[part] % m
            differ = anchor[i] != other
            row, i, part, other = row[differ], i[differ], part[differ], other[differ]
            ratio, head = self.ratio[some][row], self.head[some][row]
            high = np.searchsorted(place, part * m + i)
            soon = high - np.searchsorted(place, part * m + since_head[i])
            n = np.where(ratio >= 0, high - np.searchsorted(place, part * m + since[i]), soon)
            score = np.where(head & (soon > 0), 1.0, ratio)
            ok = n > 0
            x, y = np.minimum(anchor[i], other)[ok], np.maximum(anchor[i], other)[ok]
            codes, ns, scores = self._summed(np.append(codes, x * m + y), np.append(ns, n[ok]), np.append(scores, score[ok]))
        now = np.arange(m)  # the story that an anchor's has become
        x, y = codes // m, codes % m
        for _ in range(rounds):
            early, late = np.minimum(now[x], now[y]), np.maximum(now[x], now[y])  # places in order of time
            code, n, score = self._summed((early * m + late)[early != late], ns[early != late], scores[early != late])
            early, late = code // m, code % m
            head, open_ = self.guard(self.kind[early], self.kind[late])
            apart = self.at[late] - self.at[early]
            fit = (n >= least) & (apart <= self.hours * HOUR) & (open_ | head & (apart <= self.headline_hours * HOUR))
            early, late, score = early[fit], late[fit], score[fit]
            free = ~np.isin(early, late)
            order = np.lexsort((early[free], -score[free], late[free]))
            into, gone = early[free][order], late[free][order]
            gone, at = np.unique(gone, return_index=True)
            if not len(gone):
                break
            step = np.arange(m)
            step[gone] = into[at]
            now = step[now]
        return now[anchor]

    @staticmethod
    def _summed(code: np.ndarray, n: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(code):
            return code, n, score
        order = np.argsort(code, kind="stable")
        unique, at = np.unique(code[order], return_index=True)
        return unique, np.add.reduceat(n[order], at), np.maximum.reduceat(score[order], at)
