"""Plain-Python models of the request semantics, written from the description of a marking queue."""

from collections import defaultdict, deque

# Links, seeds and answers of the protocol as it is spoken.
FIXTURE = [
    (2, 1, "s"), (3, 1, "s"), (4, 1, "f"), (5, 1, "f"), (6, 2, "s"), (7, 2, "f"), (8, 3, "f"), (9, 6, "f"), (11, 10, "f"),
    (110, 100, "s"), (120, 100, "s"), (101, 100, "f"), (102, 100, "f"), (103, 110, "f"), (104, 120, "f"),
    (210, 200, "s"), (220, 200, "s"), (101, 200, "f"), (202, 200, "f"), (203, 210, "f"), (104, 220, "f"),
    (7, 3618826, "f"), (4, 3943817, "f"), (10, 5799448, "s"), (5, 5799448, "f"), (8, 4143367, "f"), (12, 5800000, "f"),
]
SEEDS = [(1, 3943817, 0, 1), (2, 5799448, 1, 1), (3, 91039287, 0, 2), (4, 3618826, 0, 3), (5, 4143367, 0, 4)]


class Model:
    def __init__(self, links):
        self.subs, self.files, self.blocks, self.cats = defaultdict(list), defaultdict(list), set(), set()
        for child, parent, kind in links:
            self.blocks.add(parent)
            self.cats.add(parent)
            if kind == "s":
                self.subs[parent].append(child)
                self.cats.add(child)
            elif kind == "f":
                self.files[parent].append(child)
        for f in self.files.values():
            f.sort(reverse=True)
        self.limit = max(self.blocks, default=0) + 1

    def fetch(self, root, bound):
        """Rows (id, depth, kind) in order, and the mask id -> depth + 1 (at most 255; 1 for a category that was entered)."""
        rows, mask = [], {}
        if root not in self.cats or root >= self.limit:
            return rows, mask
        todo = deque([(root, 0)])
        while todo:
            c, d = todo.popleft()
            mask[c] = 1
            if bound < 0 or d < bound:
                for x in self.subs[c]:
                    if x < self.limit and x in self.blocks and not mask.get(x):
                        todo.append((x, d + 1))
            else:
                for x in self.subs[c]:
                    if x < self.limit and not mask.get(x):
                        rows.append((x, d, "category"))
                        mask[x] = min(d + 1, 255)
            for x in self.files[c]:
                if x < self.limit and not mask.get(x):
                    rows.append((x, d, "file"))
                    mask[x] = min(d + 1, 255)
        return rows, mask

    def tags(self, seeds):
        out = {}
        for _, cat, depth, tag in sorted(seeds, reverse=True):
            _, mask = self.fetch(cat, depth)
            out.update({i: (tag, m - 1) for i, m in mask.items()})
        return out

    def request(self, a, c1, c2, d1, d2, o, s, tags):
        """(rows (id, depth, tag), outof or None)."""
        r1, _ = self.fetch(c1, d1)
        num, end, out, n = len(r1), o + s, [], 0
        tag = lambda i: tags.get(i, (0, 0))[0]
        if a == "list":
            return [(i, d, tag(i)) for i, d, _ in r1[o : max(o, min(end, num))]], num
        if a in ("and", "not"):
            r2, mask = self.fetch(c2, d2)
            if a == "and" and not r2:
                return [], 0
            for at, (i, d, _) in enumerate(r1):
                m = mask.get(i, 0)
                if (m != 0) == (a == "and"):
                    n += 1
                    if n <= o:
                        continue
                    out.append((i, d + (m - 1 if a == "and" else 0), tag(i)))
                    if n >= end:
                        return out, (end * num) // at if at else None
            return out, n - o
        if not num:
            return [], 0
        for k in (1, 2, 3, 4):
            at = num
            for j, (i, d, _) in enumerate(r1):
                if i in tags and tags[i][0] == k:
                    n += 1
                    if n <= o:
                        continue
                    out.append((i, d + tags[i][1], k))
                    if n >= end:
                        at = j
                        break
            if n >= end:
                whole = (k - 1) * num + at
                return out, (end * num * 3) // whole if whole else None
        return out, n - o

    def path(self, c1, c2, bound):
        """Ids of the shortest path, None without one."""
        parent, todo = {}, deque([(c1, 0)])
        isfile = c2 not in self.cats

        def back(x):
            ids = [x]
            while ids[-1] != c1:
                ids.append(parent[ids[-1]])
            return ids[::-1]

        while todo:
            c, d = todo.popleft()
            if bound < 0 or d < bound:
                for x in self.subs[c]:
                    if x >= self.limit:
                        continue
                    if x == c2:
                        parent[x] = c
                        return back(x)
                    if x not in parent:
                        if x != c1:
                            parent[x] = c
                        else:
                            parent.setdefault(x, c)
                        todo.append((x, d + 1))
            if isfile and c2 in self.files[c] and c2 < self.limit:
                return back(c)
        return None
