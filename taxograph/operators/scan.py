"""Searches and scans of single requests inside tasks, over sorted arrays of the whole graph.

A listing of one category can hold most files and a request shows a page of it, so a table of (request, row) pairs grows
far faster than links and requests do. Here the requests are spread over the tasks instead: each takes its searches from
the arrays, scans until its page is full, as a single queue does, and only pages leave the task. A worker loads the arrays
once (8 bytes a file edge, 9 a subcategory edge) and keeps the searches it used last, up to ``KEPT_BYTES``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq

LOW = (1 << 32) - 1
#: Bytes of searches that a worker keeps, and adjacency lists it keeps.
KEPT_BYTES, KEPT_LISTS = 96 << 20, 200_000
#: Rows of a first step of a scan, and rows of an output batch.
STEP, BATCH = 1024, 65_536

ROWS = "req_id bigint, n bigint, id int, depth int, tag int, category boolean"
TOTALS = "req_id bigint, outof bigint, found boolean, first bigint, second bigint"
SEEN = "prio int, tag int, id int, depth2 int"
_ROWS = pa.schema([("req_id", pa.int64()), ("n", pa.int64()), ("id", pa.int32()), ("depth", pa.int32()), ("tag", pa.int32()), ("category", pa.bool_())])
_TOTALS = pa.schema([("req_id", pa.int64()), ("outof", pa.int64()), ("found", pa.bool_()), ("first", pa.int64()), ("second", pa.int64())])
_SEEN = pa.schema([("prio", pa.int32()), ("tag", pa.int32()), ("id", pa.int32()), ("depth2", pa.int32())])
_NONE = np.empty(0, np.int32)


def _columns(path: str, *names: str) -> list[np.ndarray]:
    """Columns of a table, its part files by name."""
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".parquet"))
    parts = [pq.ParquetFile(fs.open_input_file(f)).read(columns=list(names)) for f in files]
    return [np.concatenate([p.column(c).to_numpy() for p in parts]) if parts else np.empty(0, np.int64) for c in names]


def _place(array: np.ndarray, value: int, side: str = "left") -> int:
    """Where a number belongs in a sorted array; given in the array's own type, else each call would convert the whole array."""
    return int(array.searchsorted(array.dtype.type(value), side))


class Graph:
    """The arrays of a graph, and the searches in it that were used last."""

    def __init__(self, path: str):
        self.parent, self.child, self.enters = _columns(f"{path}/sub-array", "parent", "child", "enters")
        self.enters = self.enters.astype(bool)
        (keys,) = _columns(f"{path}/file-array", "key")
        self.keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys  # (parent, file downwards), once each
        (self.cats,) = _columns(f"{path}/cat-array", "cat")
        (self.clash,) = _columns(f"{path}/clash-array", "cat")
        self.clash = np.sort(self.clash)
        self.lists: dict[int, tuple[list[int], list[int]]] = {}
        self.kept: OrderedDict[int, Search] = OrderedDict()
        self.bytes = 0
        self.tags: tuple[str, np.ndarray, np.ndarray, np.ndarray] | None = None

    def below(self, node: int) -> tuple[list[int], list[int]]:
        """The subcategories of a category in order, and those of them that are entered."""
        got = self.lists.get(node)
        if got is None:
            if len(self.lists) >= KEPT_LISTS:
                self.lists.clear()
            lo, hi = _place(self.parent, node), _place(self.parent, node, "right")
            children = self.child[lo:hi].tolist()
            within = self.enters[lo:hi]
            got = self.lists[node] = (children, children if within.all() else self.child[lo:hi][within].tolist())
        return got

    def is_cat(self, node: int) -> bool:
        at = _place(self.cats, node)
        return bool(at < len(self.cats) and self.cats[at] == node)

    def search(self, root: int) -> Search:
        got = self.kept.pop(root, None)
        if got is None:
            got = Search(self, root)
            self.bytes += got.bytes
        self.kept[root] = got
        while self.bytes > KEPT_BYTES and len(self.kept) > 2:
            self.bytes -= self.kept.popitem(last=False)[1].bytes
        return got

    def load_tags(self, path: str) -> None:
        if not self.tags or self.tags[0] != path:
            ids, tag, depth = _columns(path, "id", "tag", "good_depth")
            by = np.argsort(ids, kind="stable")
            self.tags = (path, ids[by], tag[by], depth[by])
            for s in self.kept.values():
                s.tagged = None

    def tags_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which ids have a tag, and tag and depth of all (0 without)."""
        _, known, tag, depth = self.tags
        if not len(known) or not len(ids):
            none = np.zeros(len(ids), np.int32)
            return none.astype(bool), none, none
        at = np.minimum(known.searchsorted(ids), len(known) - 1)
        has = known[at] == ids
        return has, np.where(has, tag[at], 0), np.where(has, depth[at], 0)


class Search:
    """All that lies below a category, without a bound, in the order of a first-in first-out queue.

    A category is marked when it leaves the queue; met again before its turn by one of its own level, it stands in the queue
    once more one level below, which matters for the rows at a bound only. ``queue`` and ``level`` are all turns, ``first``
    has the first turn of each category. ``ids``, ``lev`` and ``turn`` are the files in order, each where it is first met;
    ``sid`` and ``spos`` are the same ids in rising order and their places. A bounded listing is the rows up to that level, with rows of
    subcategories put in at the last one.
    """

    def __init__(self, graph: Graph, root: int):
        self.graph, self.root = graph, root
        queue, level, last = [root], [0], {root: 0}
        first: dict[int, int] = {}
        at = 0
        while at < len(queue):
            c, d = queue[at], level[at] + 1
            first.setdefault(c, at)
            for x in graph.below(c)[1]:
                if x not in first and last.get(x) != d:
                    last[x] = d
                    queue.append(x)
                    level.append(d)
            at += 1
        self.queue, self.level, self.first = queue, level, first
        turns = np.fromiter(first.values(), np.int32, len(first))
        nodes = np.fromiter(first, np.int64, len(first))
        lo, hi = graph.keys.searchsorted(nodes << 32), graph.keys.searchsorted((nodes + 1) << 32)
        n = hi - lo
        total = int(n.sum())
        flat = np.arange(total) + np.repeat(lo - (np.cumsum(n) - n), n)
        files = (LOW - (graph.keys[flat] & LOW)).astype(np.int32)
        by = np.argsort(files, kind="stable")
        ordered = files[by]
        once = by[np.r_[True, ordered[1:] != ordered[:-1]]] if total else by
        kept = np.sort(once)
        self.ids, of = files[kept], np.repeat(np.arange(len(first)), n)[kept]
        self.turn = turns[of]
        self.lev = np.asarray(level, np.int32)[self.turn] if total else _NONE
        self.sid = files[once]
        self.spos = kept.searchsorted(once).astype(np.int32)
        self.bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.tagged: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        both = np.minimum(self.sid.searchsorted(graph.clash), max(len(self.sid) - 1, 0))  # files that are categories too
        self.clash = np.sort(self.spos[both[self.sid[both] == graph.clash]]) if total else _NONE
        self.bytes = 1000 + 20 * len(self.ids) + 200 * len(queue)

    def end(self, bound: int) -> int:
        """The number of files within the bound."""
        return len(self.ids) if bound < 0 else _place(self.lev, bound, "right")

    def frontier(self, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """The subcategories that are rows at the bound, in order, and before which file each stands."""
        if bound < 0:
            return _NONE, _NONE
        if bound not in self.bounds:
            out: dict[int, int] = {}
            for turn in range(bisect_left(self.level, bound), bisect_right(self.level, bound)):
                for x in self.graph.below(self.queue[turn])[0]:
                    if x not in out and self.first.get(x, turn + 1) > turn:
                        out[x] = turn
            lo, hi = _place(self.lev, bound), self.end(bound)
            at = lo + self.turn[lo:hi].searchsorted(np.fromiter(out.values(), np.int32, len(out)))
            self.bounds[bound] = (np.fromiter(out, np.int32, len(out)), at)
        return self.bounds[bound]

    def depth_seen(self, node: int, bound: int, shown: dict[int, int] | set[int]) -> int:
        """The depth of an id as second operand, -1 if it was not seen. ``shown``: the subcategories that are rows."""
        turn = self.first.get(node)
        if turn is not None and (bound < 0 or self.level[turn] <= bound):
            return 0
        depths = [bound] if node in shown else []
        at = _place(self.sid, node)
        if at < len(self.sid) and self.sid[at] == node and (bound < 0 or self.lev[self.spos[at]] <= bound):
            depths.append(int(self.lev[self.spos[at]]))
        return min(min(depths), 254) if depths else -1


class Listing:
    """A search within a bound: files, and rows of subcategories between them."""

    def __init__(self, search: Search, bound: int, frontier: bool):
        self.search, self.bound, self.files = search, bound, search.end(bound)
        self.shown, self.before = search.frontier(bound) if frontier else (_NONE, _NONE)
        self.places = self.before + np.arange(len(self.shown))  # of the subcategories
        self.size = self.files + len(self.shown)

    def place(self, files: np.ndarray) -> np.ndarray:
        """The places of files, given by their number among the files."""
        return files + self.before.searchsorted(files, "right") if len(self.shown) else files

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id, depth and whether it is a subcategory, of the rows at places."""
        s = self.search
        if not len(self.shown):
            return s.ids[places], s.lev[places], np.zeros(len(places), bool)
        k = self.places.searchsorted(places)
        own = np.minimum(k, len(self.shown) - 1)
        category = self.places[own] == places
        file = np.where(category, 0, places - k)
        if not self.files:
            return self.shown[own], np.full(len(places), self.bound, np.int32), category
        return np.where(category, self.shown[own], s.ids[file]), np.where(category, self.bound, s.lev[file]), category


class Pair:
    """At which level the second search meets the files of the first; told as far as a scan has come, for all bounds."""

    def __init__(self, one: Search, two: Search):
        self.one, self.two, self.done = one, two, 0
        self.sparse = 8 * len(two.ids) <= len(one.ids)
        if self.sparse:
            hit = one.sid.searchsorted(two.sid)
            hit = np.minimum(hit, max(len(one.sid) - 1, 0))
            same = one.sid[hit] == two.sid if len(one.sid) else np.zeros(len(two.sid), bool)
            at, lev = one.spos[hit[same]] if len(one.sid) else _NONE, two.lev[two.spos[same]]
            by = np.argsort(at)
            self.at, self.lev = at[by], lev[by]
        else:
            self.got = np.empty(len(one.ids), np.int32)

    def levels(self, lo: int, hi: int) -> np.ndarray:
        """For files lo to hi of the first search: the level, -1 for those that are not met."""
        if self.sparse:
            out = np.full(hi - lo, -1, np.int32)
            a, b = _place(self.at, lo), _place(self.at, hi)
            out[self.at[a:b] - lo] = self.lev[a:b]
            return out
        if hi > self.done:
            two, ids = self.two, self.one.ids[self.done : hi]
            k = np.minimum(two.sid.searchsorted(ids), len(two.sid) - 1)
            self.got[self.done : hi] = np.where(two.sid[k] == ids, two.lev[two.spos[k]], -1)
            self.done = hi
        return self.got[lo:hi]


def _hits(one: Listing, two: Listing, pair: Pair, negate: bool, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``one`` of ids that ``two`` has seen (or not), and the depths there: the first ``need`` or all."""
    bound, want = two.bound, need + len(one.search.clash)
    found, depths, held = [], [], 0
    if pair.sparse and not negate:
        end = _place(pair.at, one.files)
        ok = np.ones(end, bool) if bound < 0 else pair.lev[:end] <= bound
        found, depths = [pair.at[:end][ok][:want]], [pair.lev[:end][ok][:want]]
    else:
        lo, step = 0, max(STEP, min(4 * need, 1 << 20))
        while lo < one.files and held < want:
            hi = min(lo + step, one.files)
            lev = pair.levels(lo, hi)
            met = lev >= 0 if bound < 0 else (lev >= 0) & (lev <= bound)
            new = np.flatnonzero(~met if negate else met)
            found.append(new + lo)
            depths.append(lev[new])
            held += len(new)
            lo, step = hi, min(2 * step, 1 << 20)
    files = np.concatenate(found) if found else _NONE
    depth = np.minimum(np.concatenate(depths), 254) if depths else _NONE
    clash = one.search.clash[: _place(one.search.clash, one.files)]
    if len(clash):
        keep = ~np.isin(files, clash)
        files, depth = files[keep], depth[keep]
    places = one.place(files)
    if len(clash) or len(one.shown):
        # ids of categories are looked up one by one
        shown = set(two.shown.tolist())
        special = np.concatenate([one.place(clash), one.places])
        seen = np.array([two.search.depth_seen(x, bound, shown) for x in [*one.search.ids[clash].tolist(), *one.shown.tolist()]], np.int32)
        ok = seen < 0 if negate else seen >= 0
        places, depth = np.concatenate([places, special[ok]]), np.concatenate([depth, seen[ok]])
        by = np.argsort(places, kind="stable")
        places, depth = places[by], depth[by]
    return places[:need], depth[:need]


def _tagged(graph: Graph, one: Listing) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and tag depths of the rows of each tag from 1 to 4."""
    s = one.search
    if s.tagged is None:
        _, known, tag, depth = graph.tags
        if len(known) < len(s.sid):
            k = np.minimum(s.sid.searchsorted(known), len(s.sid) - 1)
            same = s.sid[k] == known
            at = s.spos[k[same]]
            by = np.argsort(at)
            s.tagged = (at[by], tag[same][by], depth[same][by])
        else:
            has, of, good = graph.tags_of(s.ids)
            s.tagged = (np.flatnonzero(has), of[has], good[has])
    end = _place(s.tagged[0], one.files)
    places, tag, depth = one.place(s.tagged[0][:end]), s.tagged[1][:end], s.tagged[2][:end]
    if len(one.shown):
        has, of, good = graph.tags_of(one.shown)
        places, tag, depth = np.concatenate([places, one.places[has]]), np.concatenate([tag, of[has]]), np.concatenate([depth, good[has]])
        by = np.argsort(places, kind="stable")
        places, tag, depth = places[by], tag[by], depth[by]
    return [(places[tag == k], depth[tag == k]) for k in (1, 2, 3, 4)]


class Tree:
    """All categories below a root in the order of a queue, each where it is first met: ``up`` has the place of its parent.

    A file is looked for in each category, until that has taken as many looks as there are files; from then on in an
    index of all files, each with the first category that holds it.
    """

    def __init__(self, graph: Graph, root: int):
        self.graph, self.root = graph, root
        queue, depth, up = [root], [0], {root: -1}
        at = 0
        while at < len(queue):
            for x in graph.below(queue[at])[0]:
                if x not in up:
                    up[x] = at
                    queue.append(x)
                    depth.append(depth[at] + 1)
            at += 1
        self.queue, self.depth, self.up = queue, depth, up
        self.low: np.ndarray | None = None
        self.looks = 0
        self.ids: np.ndarray | None = None

    def holder(self, file: int) -> int:
        """The place of the first category that holds a file, -1 for none."""
        keys = self.graph.keys
        if self.low is None:
            self.low = np.asarray(self.queue, np.int64) << 32
            self.lo, self.hi = keys.searchsorted(self.low), keys.searchsorted(self.low + (1 << 32))
            self.total = int((self.hi - self.lo).sum())
        if self.ids is None:
            self.looks += len(self.queue)
            if self.looks <= self.total:
                own = self.low | (LOW - file)
                k = np.minimum(keys.searchsorted(own), len(keys) - 1)
                at = np.flatnonzero(keys[k] == own)
                return int(at[0]) if len(at) else -1
            n = self.hi - self.lo
            flat = np.arange(self.total) + np.repeat(self.lo - (np.cumsum(n) - n), n)
            files = (LOW - (keys[flat] & LOW)).astype(np.int32)
            by = np.argsort(files, kind="stable")
            files = files[by]
            once = np.r_[True, files[1:] != files[:-1]] if self.total else np.empty(0, bool)
            self.ids, self.places = files[once], np.repeat(np.arange(len(n), dtype=np.int32), n)[by[once]]
        k = _place(self.ids, file)
        return int(self.places[k]) if k < len(self.ids) and self.ids[k] == file else -1


def wrapped(x: int) -> int:
    """A number as it comes out of 32-bit arithmetic."""
    return (x + (1 << 31)) % (1 << 32) - (1 << 31)


def _div(a: int, b: int) -> int:
    """Division that drops the fraction."""
    return a // b if a >= 0 else -(-a // b)


class Scanner:
    """Answers requests that come sorted by c1 and c2; what follows shares the pair and the hits of what was before."""

    def __init__(self, graph: Graph, frontier: bool):
        self.graph, self.frontier = graph, frontier
        self.pair: Pair | None = None
        self.tree: Tree | None = None

    def answers(self, group: list[tuple]) -> Iterator[tuple]:
        """``(req_id, places or path, depths, tags, listing, low, outof, found, first, second)`` of requests
        ``(req_id, a, c1, c2, d1, d2, o, s)`` that differ in req_id, o and s only."""
        _, a, c1, c2, d1, d2, _, _ = group[0]
        if a == "path":
            path = self.path(c1, c2, d1)
            for r in group:
                yield r[0], path or [], None, None, None, 0, None, path is not None, 0, 0
            return
        one = Listing(self.graph.search(c1), d1, self.frontier)
        windows = [(r[0], max(r[6], 0), r[6] + r[7], r[6]) for r in group]
        if a == "list":
            for q, low, end, _ in windows:
                yield q, np.arange(low, max(low, min(end, one.size))), None, None, one, low, one.size, True, one.size, 0
            return
        if a == "fqv":
            passes = _tagged(self.graph, one)
            for q, low, end, o in windows:
                yield self._fqv(q, passes, one, low, end, o)
            return
        two = Listing(self.graph.search(c2), d2, self.frontier)
        need = max(max(end, low + 1) for _, low, end, _ in windows)
        if a == "and" and not two.size:
            places, depths = _NONE, _NONE
        else:
            if not self.pair or self.pair.one is not one.search or self.pair.two is not two.search:
                self.pair = Pair(one.search, two.search)
            places, depths = _hits(one, two, self.pair, a == "not", need)
        for q, low, end, o in windows:
            last = max(end, low + 1)
            if a == "and" and not two.size:
                outof = 0
            elif last > len(places):
                outof = wrapped(len(places) - o)
            else:
                stop = int(places[last - 1])
                outof = _div(wrapped(end * one.size), stop) if stop else None
            yield q, places[low:last], depths[low:last] if a == "and" else None, None, one, low, outof, True, one.size, two.size

    def _fqv(self, q: int, passes: list[tuple[np.ndarray, np.ndarray]], one: Listing, low: int, end: int, o: int) -> tuple:
        last, before, stop = max(end, low + 1), 0, None
        places, depths, tags, ended = [_NONE], [_NONE], [_NONE], None
        for k, (at, good) in enumerate(passes, 1):
            if k == 1 or before < end:
                lo, hi = max(low - before, 0), max(last - before, 0)
                got = at[lo:hi]
                places.append(got)
                depths.append(good[lo:hi])
                tags.append(np.full(len(got), k, np.int32))
                if before < last <= before + len(at):
                    stop = (k, int(at[last - before - 1]))
            before += len(at)
            if ended is None and before >= end:
                ended = k
        num = one.size
        at, ended = (stop[1], stop[0]) if stop else (num, ended)
        if not num:
            outof = 0
        elif ended is None:
            outof = wrapped(before - o)
        else:
            whole = wrapped((ended - 1) * num + at)
            outof = _div(wrapped(wrapped(end * num) * 3), whole) if whole > 0 else None
        return q, np.concatenate(places), np.concatenate(depths), np.concatenate(tags), one, low, outof, True, num, 0

    def path(self, root: int, goal: int, bound: int) -> list[int] | None:
        """The ids of the shortest path found first; a file's path ends at the first category that holds it."""
        graph = self.graph
        if not self.tree or self.tree.root != root:
            self.tree = Tree(graph, root)
        queue, depth, up = self.tree.queue, self.tree.depth, self.tree.up
        if goal in up:
            at = depth[up[goal]] + 1
            if bound >= 0 and at > bound:
                return None
            node = goal
        elif graph.is_cat(goal) or goal < 0 or not len(graph.keys):
            return None
        else:
            at = self.tree.holder(goal)
            if at < 0 or (bound >= 0 and depth[at] > bound):
                return None
            node = queue[at]
        ids = [node]
        while up[node] >= 0:
            node = queue[up[node]]
            ids.append(node)
        return ids[::-1]


_LOADED: dict[str, Graph] = {}


def _graph(path: str) -> Graph:
    """The arrays in a folder, loaded once in a worker; those of another graph make room."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Graph(path)
    return _LOADED[path]


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    group: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and group[-1][1:6] != r[1:6]:
                yield group
                group = []
            group.append(r)
    if group:
        yield group


def page_rows(arrays: str, tags: str, frontier: bool):
    """A function from batches of requests to batches of ``ROWS``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count, scanner = 0, None
        for group in _groups(batches):
            if scanner is None:
                graph = _graph(arrays)
                graph.load_tags(tags)
                scanner = Scanner(graph, frontier)
            for q, places, depths, of, one, low, *_ in scanner.answers(group):
                for lo in range(0, len(places), BATCH):  # a page may be of any size
                    part = slice(lo, lo + BATCH)
                    if one is None:
                        ids = np.asarray(places[part], np.int32)
                        held.append((q, lo + 1, ids, np.arange(lo + 1, lo + 1 + len(ids)), np.zeros(len(ids), np.int32), np.ones(len(ids), bool)))
                    else:
                        ids, depth, category = one.at(places[part])
                        held.append((q, lo + 1, ids, depth if depths is None else depth + depths[part], None if of is None else of[part], category))
                    count += len(held[-1][2])
                    if count >= BATCH:
                        yield _batch(graph, held)
                        held, count = [], 0
        if held:
            yield _batch(graph, held)

    return run


def _batch(graph: Graph, held: list[tuple]) -> pa.RecordBatch:
    sizes = np.array([len(x[2]) for x in held])
    ids = np.concatenate([x[2] for x in held])
    starts = np.repeat(np.array([x[1] for x in held]) - (np.cumsum(sizes) - sizes), sizes)
    given = np.concatenate([np.zeros(len(x[2]), np.int32) if x[4] is None else x[4] for x in held])
    tag = np.where(np.repeat([x[4] is None for x in held], sizes), graph.tags_of(ids)[1], given)
    columns = [np.repeat(np.array([x[0] for x in held], np.int64), sizes), starts + np.arange(len(ids)), ids, np.concatenate([x[3] for x in held]), tag, np.concatenate([x[5] for x in held])]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype(), copy=False), f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)


def page_sizes(arrays: str, tags: str, frontier: bool):
    """A function from batches of requests to batches of ``TOTALS``; ``first`` and ``second`` are the sizes of the listings."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        scanner = None
        for group in _groups(batches):
            if scanner is None:
                graph = _graph(arrays)
                graph.load_tags(tags)
                scanner = Scanner(graph, frontier)
            out += [(x[0], *x[6:]) for x in scanner.answers(group)]
            if len(out) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _TOTALS, strict=True)], schema=_TOTALS)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _TOTALS, strict=True)], schema=_TOTALS)

    return run


def seen_rows(arrays: str):
    """A function from batches of seeds ``(prio, root, bound, tag)`` to batches of ``SEEN``: what their searches have seen."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for prio, root, bound, tag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = _graph(arrays).search(root)
                entered = [c for c, turn in s.first.items() if bound < 0 or s.level[turn] <= bound]
                shown, end = s.frontier(bound)[0], s.end(bound)
                ids = np.concatenate([np.array(entered, np.int32), shown, s.ids[:end]])
                depths = np.concatenate([np.zeros(len(entered), np.int32), np.full(len(shown), bound, np.int32), s.lev[:end]])
                for lo in range(0, len(ids), BATCH):
                    part = ids[lo : lo + BATCH]
                    columns = [np.full(len(part), prio), [tag] * len(part), part, np.minimum(depths[lo : lo + BATCH], 254)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SEEN, strict=True)], schema=_SEEN)

    return run
