"""Licence scans: matching statistics against a generalised suffix automaton of licence words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from noticegrid.llm import batches
from noticegrid.llm.license_templates import NOTICES, PHRASES

LEAST_MATCH = 4  # words of a match worth chaining
MOST_GAP = 12  # words between two matches of one chain, in the text and in the notice
COVERED = 0.75  # share of a notice's words that its chain must cover
SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    "score double, spans string"
)
# After lowering A-Z, a word is a run of digits, letters a-z and bytes of other characters.
TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(TABLE).split()


class Automaton:
    """Generalised suffix automaton over word numbers; each state knows its ends in the notices.

    ``ends[state]`` lists (notice, position after the last word) of the state's strings.
    """

    def __init__(self, notices: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for k, notice in enumerate(notices):
            last = 0
            for place, word in enumerate(notice, 1):
                last = self._extend(last, word, own)
                own[last].append((k, place))
        self.ends: list[list[tuple[int, int]]] = [[] for _ in own]
        for state in sorted(range(len(own)), key=lambda s: -self.length[s]):
            self.ends[state] = sorted(set(self.ends[state] + own[state]))
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]

    def _new(self, length: int, edges: dict, link: int, own: list) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        own.append([])
        return len(self.next) - 1

    def _split(self, p: int, word: int, own: list) -> int:
        """The state of the longest string that ends p's with ``word``; cut off if it is only a part of one."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q], own)
        self.link[q] = part
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = part
            p = self.link[p]
        return part

    def _extend(self, last: int, word: int, own: list) -> int:
        if word in self.next[last]:
            return self._split(last, word, own)
        state = self._new(self.length[last] + 1, {}, 0, own)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, word, own)
        return state

    def matches(self, run: list[int], least: int) -> list[tuple[int, int, int]]:
        """(start, length, state) of the right-maximal matches of ``least`` words or more in a run of words."""
        state, size, found = 0, 0, []
        for i, word in enumerate(run):
            before = (i - size, size, state)
            step = self.next[state].get(word)
            while step is None and state:
                state = self.link[state]
                size = self.length[state]
                step = self.next[state].get(word)
            if step is None:
                size = 0
            else:
                state, size = step, size + 1
            if before[1] >= least and size <= before[1]:  # the match did not grow
                found.append(before)
        if size >= least:
            found.append((len(run) - size, size, state))
        return found


class Scanner:
    """Vocabulary, automaton and phrases; made once a task."""

    def __init__(self, least: int = LEAST_MATCH, gap: int = MOST_GAP, share: float = COVERED):
        self.least, self.gap, self.share = least, gap, share
        texts = [(label, words(text)) for label, group in NOTICES.items() for text in group]
        self.labels = [label for label, _ in texts]
        self.numbers: dict[bytes, int] = {}
        number = lambda w: self.numbers.setdefault(w, len(self.numbers))
        self.notices = [[number(w) for w in ws] for _, ws in texts]
        self.phrases = [(label, [number(w) for w in phrase.encode().split()]) for phrase, label in PHRASES.items()]
        self.automaton = Automaton(self.notices)

    def known(self, found: list[bytes]) -> np.ndarray:
        """Numbers of a text's words, -1 for words of no notice."""
        get = self.numbers.get
        return np.fromiter((get(w, -1) for w in found), np.int64, len(found))

    def base(self, ids: np.ndarray) -> tuple[list[int], set[str]]:
        """Starts and labels of the phrases."""
        starts, labels = [], set()
        for label, phrase in self.phrases:
            size = len(phrase)
            if len(ids) < size:
                continue
            hit = np.ones(len(ids) - size + 1, bool)
            for j, word in enumerate(phrase):
                hit &= ids[j:len(ids) - size + 1 + j] == word
            at = np.flatnonzero(hit)
            if len(at):
                starts += at.tolist()
                labels.add(label)
        return starts, labels

    def spans(self, ids: np.ndarray) -> list[tuple[int, int, str, float]]:
        """(start, end, label, covered share) of the chains that cover enough of a notice.

        Unknown words end every match, so the automaton only walks through runs of known ones.
        """
        inside = ids >= 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
        runs = edge.reshape(-1, 2)
        by_notice: dict[int, list[tuple[int, int, int]]] = {}
        for start, end in runs[runs[:, 1] - runs[:, 0] >= self.least].tolist():
            for at, size, state in self.automaton.matches(ids[start:end].tolist(), self.least):
                for notice, stop in self.automaton.ends[state]:
                    by_notice.setdefault(notice, []).append((start + at, stop - size, size))
        out = []
        for notice, found in by_notice.items():
            length = len(self.notices[notice])
            for chain in chains(found, self.gap):
                covered = sum(b - a for a, b in merged([(p, p + n) for _, p, n in chain]))
                if covered >= self.share * length:
                    out.append((chain[0][0], chain[-1][0] + chain[-1][2], self.labels[notice], covered / length))
        return best_spans(out)


def chains(found: list[tuple[int, int, int]], gap: int) -> list[list[tuple[int, int, int]]]:
    """Matches (text place, notice place, words) of one notice, joined while both places move on by ``gap`` words at most."""
    done: list[list[tuple[int, int, int]]] = []
    open_: list[list[tuple[int, int, int]]] = []
    for match in sorted(found):
        still = [c for c in open_ if match[0] <= c[-1][0] + c[-1][2] + gap]
        done += [c for c in open_ if match[0] > c[-1][0] + c[-1][2] + gap]
        open_ = still
        for chain in reversed(open_):
            at, place, size = chain[-1]
            if at < match[0] and place < match[1] <= place + size + gap:
                chain.append(match)
                break
        else:
            open_.append([match])
    return done + open_


def merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def best_spans(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Of overlapping spans the one with more covered words; of equal ones the one with the larger share."""
    out: list[tuple[int, int, str, float]] = []
    for span in sorted(set(found), key=lambda s: (-(s[1] - s[0]), -s[3], s[0], s[2])):
        if all(span[1] <= o[0] or o[1] <= span[0] for o in out):
            out.append(span)
    return sorted(out)


def licenses(docs: DataFrame, *, least: int = LEAST_MATCH, gap: int = MOST_GAP, share: float = COVERED) -> DataFrame:
    """Phrase places, labels and covered notices of every row, from its whole text (see ``SCHEMA``).

    ``spans`` lists label:first word:end word of the covered notices, ``score`` is the largest
    covered share of a notice, 0 without any. A null, empty or wordless text has no place, no label
    (empty strings) and null first and last words. Repeated rows give a row each; an empty table
    gives none.
    """

    def make():
        scanner = Scanner(least, gap, share)

        def work(ids, texts):
            out: dict[str, list] = {part.split()[0]: [] for part in SCHEMA.split(", ")}
            out["doc_id"] = ids
            for text in texts:
                found = words(text)
                numbers = scanner.known(found)
                starts, base = scanner.base(numbers)
                spans = scanner.spans(numbers)
                out["n_words"].append(len(found))
                out["n_base"].append(len(starts))
                out["first_word"].append(min(starts, default=None))
                out["last_word"].append(max(starts, default=None))
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | {s[2] for s in spans})))
                out["score"].append(max((s[3] for s in spans), default=0.0))
                out["spans"].append(",".join(f"{label}:{a}:{b}" for a, b, label, _ in spans))
            return out

        return work

    return batches.per_slice(docs, make, SCHEMA)
