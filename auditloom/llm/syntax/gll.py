"""Generalised LL recognition with a graph-structured stack.

All alternatives that the next token allows are followed at once. A stack node is (nonterminal, position), its
edges carry the slot to return to, so calls from several contexts share one node and the work stays polynomial
for any grammar, ambiguous and left-recursive ones included. Grammars are dicts: nonterminal -> alternatives,
each a tuple of symbols; symbols that are no nonterminals are terminals.
"""

from __future__ import annotations


class Gll:
    def __init__(self, rules: dict[str, list[tuple[str, ...]]], start: str, keep: set[str]):
        self.rules, self.start, self.keep = rules, start, keep
        self._first_follow()
        # slots: index -> (symbol or None at the end, is nonterminal, next slot, nonterminal of the slot, select)
        self.slots: list[tuple] = []
        self.alts: dict[str, list[tuple[frozenset, int]]] = {}
        for nt, alts in rules.items():
            self.alts[nt] = []
            for alt in alts:
                f, empty = self._of(alt)
                self.alts[nt].append((frozenset(f | (self.follow[nt] if empty else set())), len(self.slots)))
                for k, sym in enumerate(alt):
                    self.slots.append((sym, sym in rules, len(self.slots) + 1))
                self.slots.append((None, False, -1))
        # the alternatives that each next token selects
        self.select = {nt: {} for nt in rules}
        for nt, alts in self.alts.items():
            for f, slot in alts:
                for t in f:
                    self.select[nt].setdefault(t, []).append(slot)

    def _of(self, seq):
        out = set()
        for sym in seq:
            f, empty = (self.first[sym], sym in self.nullable) if sym in self.rules else ({sym}, False)
            out |= f
            if not empty:
                return out, False
        return out, True

    def _first_follow(self):
        self.first = {n: set() for n in self.rules}
        self.follow = {n: set() for n in self.rules}
        self.follow[self.start].add("EOF")
        self.nullable: set[str] = set()
        size = -1
        while size != (size := sum(map(len, self.first.values())) + len(self.nullable)):
            for n, alts in self.rules.items():
                for alt in alts:
                    f, empty = self._of(alt)
                    self.first[n] |= f
                    if empty:
                        self.nullable.add(n)
        size = -1
        while size != (size := sum(map(len, self.follow.values()))):
            for n, alts in self.rules.items():
                for alt in alts:
                    for k, sym in enumerate(alt):
                        if sym in self.rules:
                            f, empty = self._of(alt[k + 1 :])
                            self.follow[sym] |= f | (self.follow[n] if empty else set())

    def spans(self, kinds: list[str]) -> set[tuple[str, int, int]]:
        """(nonterminal, from, to) of every recognised instance of the kept nonterminals; kinds ends with EOF."""
        slots, select, keep = self.slots, self.select, self.keep
        found: set[tuple[str, int, int]] = set()
        root = (self.start, 0)
        edges: dict[tuple, dict] = {root: {}}
        popped: dict[tuple, set] = {root: set()}
        seen: set[tuple] = set()
        todo = [(s, root, 0) for s in select[self.start].get(kinds[0], ())]
        while todo:
            slot, node, i = todo.pop()
            while True:
                sym, is_rule, nxt = slots[slot]
                if sym is None:
                    done = popped[node]
                    if i not in done:
                        done.add(i)
                        if node[0] in keep:
                            found.add((node[0], node[1], i))
                        for ret, parent in edges[node]:
                            d = (ret, parent, i)
                            if d not in seen:
                                seen.add(d)
                                todo.append(d)
                    break
                if is_rule:
                    call, back = (sym, i), (nxt, node)
                    if call not in edges:
                        edges[call] = {back: None}
                        popped[call] = set()
                        for s in select[sym].get(kinds[i], ()):
                            todo.append((s, call, i))
                    elif back not in edges[call]:
                        edges[call][back] = None
                        for j in popped[call]:
                            d = (nxt, node, j)
                            if d not in seen:
                                seen.add(d)
                                todo.append(d)
                    break
                if kinds[i] != sym:
                    break
                slot, i = nxt, i + 1
        return found
