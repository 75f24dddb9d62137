"""A plain tableau for ALCHQ, for the small ontologies of tests: concepts are tuples, roles strings.

("name", a), ("not", c), ("and", c, d), ("or", c, d), ("some", r, c), ("only", r, c), ("min", n, r, c), ("max", n, r, c), "top", "bottom"
"""

from itertools import combinations


def nnf(c, positive=True):
    if c in ("top", "bottom"):
        return c if positive else ("bottom" if c == "top" else "top")
    op = c[0]
    if op == "name":
        return c if positive else ("not", c)
    if op == "not":
        return nnf(c[1], not positive)
    if op in ("and", "or"):
        return ((op if positive else {"and": "or", "or": "and"}[op]), nnf(c[1], positive), nnf(c[2], positive))
    if op in ("some", "only"):
        return ((op if positive else {"some": "only", "only": "some"}[op]), c[1], nnf(c[2], positive))
    if op == "min":
        if positive:
            return ("min", c[1], c[2], nnf(c[3]))
        return ("max", c[1] - 1, c[2], nnf(c[3])) if c[1] else "bottom"
    return ("max", c[1], c[2], nnf(c[3])) if positive else ("min", c[1] + 1, c[2], nnf(c[3]))


class Tableau:
    def __init__(self, gcis, up):
        self.gcis, self.up = [nnf(("or", ("not", a), b)) for a, b in gcis], up  # up[r]: r and all above it

    def satisfiable(self, concepts, above=()):
        return any(self._values(done, above) for done in self._boolean([*concepts, *self.gcis], frozenset()))

    def _boolean(self, todo, done):
        """All clash-free ways to decide unions."""
        todo = list(todo)
        while todo:
            c = todo.pop()
            if c == "top" or c in done:
                continue
            if c == "bottom" or nnf(c, False) in done and c[0] in ("name", "not"):
                return
            if c[0] == "and":
                todo += [c[1], c[2]]
                done = done | {c}
            elif c[0] == "or":
                if c[1] in done or c[2] in done:
                    continue
                yield from self._boolean([*todo, c[1]], done)
                yield from self._boolean([*todo, c[2]], done)
                return
            else:
                done = done | {c}
        yield done

    def _values(self, label, above):
        if any(label <= a for a in above):
            return True
        values = []
        for c in label:
            if c[0] == "some":
                values.append((frozenset(self.up[c[1]]), frozenset({c[2]}), None))
            elif c[0] == "min":
                values += [(frozenset(self.up[c[2]]), frozenset({c[3]}), (c, i)) for i in range(c[1])]
        marked = [(r, ls, frozenset() if m is None else frozenset({m})) for r, ls, m in values]
        return self._settle(label, marked, (*above, label))

    def _settle(self, label, values, above):
        most = [c for c in label if c[0] == "max"]
        for k, (roles, own, marks) in enumerate(values):  # demands on all values, and a decision for each bound
            more = own | {c[2] for c in label if c[0] == "only" and c[1] in roles}
            if more != own:
                return self._settle(label, [*values[:k], (roles, more, marks), *values[k + 1 :]], above)
            for c in most:
                if c[2] in roles and c[3] not in own and nnf(c[3], False) not in own and c[3] != "top":
                    return any(self._settle(label, [*values[:k], (roles, own | {d}, marks), *values[k + 1 :]], above) for d in (c[3], nnf(c[3], False)))
        for c in most:
            held = [k for k, (roles, own, _) in enumerate(values) if c[2] in roles and (c[3] in own or c[3] == "top")]
            if len(held) > c[1]:
                for i, j in combinations(held, 2):
                    a, b = values[i], values[j]
                    if {m[0] for m in a[2]} & {m[0] for m in b[2]}:  # two of one lower bound differ
                        continue
                    rest = [v for k, v in enumerate(values) if k not in (i, j)]
                    if self._settle(label, [*rest, (a[0] | b[0], a[1] | b[1], a[2] | b[2])], above):
                        return True
                return False
        return all(self.satisfiable(own, above) for _, own, _ in values)
