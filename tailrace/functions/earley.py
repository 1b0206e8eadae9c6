"""Weighted Earley parsing of token-class sequences, with shared prefixes.

A grammar is a set of weighted productions over *token classes* (one-character
or short string names produced by a lexer).  The parser keeps, for every item,
the highest-scoring derivation seen so far together with the spans it captured.

An Earley set depends only on the token classes to its left, so the sets of a
line's first tokens are kept in a trie keyed by token class: two lines that
start alike share the work, and a line whose layout was met before costs one
dictionary lookup a token.  The trie never changes a result and is bounded: it
holds sets down to ``keep_depth`` tokens, and a line that begins when it has
``max_nodes`` of them starts a new one.  Beyond that depth a set lives only as
long as a later one refers to it, so a line takes time in proportion to its
length if the grammar's repetitions are left-recursive.

A production may end in ``ANY``, which matches every remaining token.  Once all
live items of a set stand before ``ANY`` no later token can change the parse;
such a set is *saturated* and the caller may stop reading tokens there.
"""

from __future__ import annotations

from dataclasses import dataclass

ANY = "*"


@dataclass(frozen=True)
class Rule:
    """``left -> right`` with a score.

    ``captures`` maps a position of ``right`` to the name of the field that the
    token (or, for ``ANY``, the rest of the line from that token) fills.
    """

    left: str
    right: tuple[str, ...]
    weight: float = 0.0
    captures: tuple[tuple[int, str], ...] = ()


class _Node:
    """An Earley set.  An item is (rule, dot, set it began in); ``waiting`` has the
    unfinished ones by the symbol they stand before, with score and captures."""

    __slots__ = ("depth", "waiting", "children", "saturated", "best")

    def __init__(self, depth: int):
        self.depth = depth
        self.waiting: dict[str, dict] = {}
        self.children: dict[str, _Node] = {}
        self.saturated = False
        self.best: tuple | None = None


class WeightedEarley:
    def __init__(self, rules: list[Rule], start: str, max_nodes: int = 20_000, keep_depth: int = 64):
        self.rules = rules
        self.start = start
        self.max_nodes = max_nodes
        self.keep_depth = keep_depth
        self.by_left: dict[str, list[int]] = {}
        for k, r in enumerate(rules):
            if not r.right:
                raise ValueError("empty productions are not supported")
            if ANY in r.right[:-1]:
                raise ValueError("ANY must end a production")
            if ANY in r.right and r.left != start:
                raise ValueError("ANY may only stand in productions of the start symbol")
            self.by_left.setdefault(r.left, []).append(k)
        self._captured = [dict(r.captures) for r in rules]
        self._reset()

    def _reset(self) -> None:
        self.size = 1
        self.root = _Node(0)
        self._close(self.root, [((k, 0, self.root), (self.rules[k].weight, ())) for k in self.by_left[self.start]])

    def begin(self) -> _Node:
        """The set before the first token of a line."""
        if self.size >= self.max_nodes:
            self._reset()
        return self.root

    def _close(self, node: _Node, seeds: list) -> None:
        """Prediction and completion until nothing improves."""
        rules, by_left, waiting = self.rules, self.by_left, node.waiting
        finished: dict = {}
        predicted: set = set()
        agenda = list(seeds)
        while agenda:
            item, found = agenda.pop()
            k, dot, origin = item
            rule = rules[k]
            right = rule.right
            if dot == len(right):
                old = finished.get(item)
                if old is not None and old[0] >= found[0]:
                    continue
                finished[item] = found
                score, caps = found
                for (pk, pdot, porigin), (p_score, p_caps) in origin.waiting.get(rule.left, {}).items():
                    agenda.append(((pk, pdot + 1, porigin), (p_score + score, p_caps + caps)))
                continue
            symbol = right[dot]
            known = waiting.get(symbol)
            if known is None:
                known = waiting[symbol] = {}
            old = known.get(item)
            if old is not None and old[0] >= found[0]:
                continue
            known[item] = found
            if symbol in by_left and symbol not in predicted:
                predicted.add(symbol)
                for q in by_left[symbol]:
                    agenda.append(((q, 0, node), (rules[q].weight, ())))
        node.saturated = bool(waiting) and all(s == ANY for s in waiting)
        start = self.start
        for group in (finished, waiting.get(ANY, {})):
            for (k, dot, origin), (score, caps) in group.items():
                if rules[k].left == start and origin.depth == 0 and (node.best is None or score > node.best[0]):
                    node.best = (score, k, caps)

    def child(self, node: _Node, token: str) -> _Node:
        """The set after one more token of class ``token``."""
        nxt = _Node(node.depth + 1)
        seeds = []
        for (k, dot, origin), (score, caps) in node.waiting.get(token, {}).items():
            name = self._captured[k].get(dot)
            seeds.append(((k, dot + 1, origin), (score, caps + ((name, node.depth),) if name else caps)))
        for item, (score, caps) in node.waiting.get(ANY, {}).items():
            name = self._captured[item[0]].get(item[1])
            if name and not any(c[0] == name for c in caps):
                caps = caps + ((name, node.depth),)
            seeds.append((item, (score, caps)))
        self._close(nxt, seeds)
        if node.depth < self.keep_depth:
            node.children[token] = nxt
            self.size += 1
        return nxt

    def judge(self, node: _Node) -> tuple | None:
        """(score, rule number, captures) of the best complete parse ending here."""
        return node.best

    def parse(self, tokens) -> tuple | None:
        """Best parse of an iterable of token classes (tests and tools)."""
        node = self.begin()
        for t in tokens:
            node = node.children.get(t) or self.child(node, t)
        return self.judge(node)
