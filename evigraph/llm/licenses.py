"""License scans by template markup.

A template is a text with two kinds of markup: [[...]] is optional, {{n}} stands for up to n replaceable words. Its words and those of a document are
compared without case and punctuation. A template compiles to a token automaton; a document has the license if a stretch of its words is accepted:
every mandatory word in its place, optional stretches whole or not at all, replaceable regions within their bounds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Phrases and their labels (fixed values of the query contract).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Templates by label: public license wording (fixed values).
TEMPLATES = {
    "mit-notice": "[[this {{3}} is]] released under the [[terms of the]] MIT license",
    "mit-text": (
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files [[(the \"Software\")]], to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: the above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software. "
        "the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. "
        "in no event shall {{10}} be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"
    ),
    "isc-text": (
        "permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "the software is provided \"as is\" and {{6}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
    ),
    "bsd-text": (
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: [[1]] redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. [[2]] redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "[[[[3]] neither the name of {{12}} nor the names of {{3}} contributors may be used to endorse or promote products derived from this software without specific prior written permission.]] this software is provided by {{12}} \"as is\""
    ),
    "apache-2.0": "[[this {{3}} is]] licensed under the Apache License, version 2.0 [[(the \"License\") [[you may not use this file except in compliance with the License. you may obtain a copy of the License at]]]]",
    "gpl-3.0": "[[this {{3}} is]] licensed under the GNU General Public License, [[either]] version 3 [[or any later version]]",
    "gpl-notice": "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation[[, either]] version {{1}} [[of the License]]",
    "cc-by": "[[this {{3}} is]] licensed under [[a]] [[the]] CC BY [[SA]] 4.0",
    "cc-by-nc": "[[this {{3}} is]] licensed under [[a]] [[the]] CC BY-NC [[SA]] 4.0",
}
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8, with A-Z lower-cased."""
    return _WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


@dataclass
class Automaton:
    """States of a compiled template: words[s] leads from s on by that word, free[s] by any word, skip[s] without a word. The last state accepts."""

    label: str
    words: list[dict[bytes, int]] = field(default_factory=list)
    free: list[int | None] = field(default_factory=list)
    skip: list[list[int]] = field(default_factory=list)
    anchor: list[bytes] = field(default_factory=list)
    first: frozenset[bytes] = frozenset()

    def state(self) -> int:
        self.words.append({})
        self.free.append(None)
        self.skip.append([])
        return len(self.words) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, out = [*states], set(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def accepts_at(self, words: list[bytes], at: int) -> bool:
        """Whether a stretch that starts at this word is accepted."""
        now, final = self.closure({0}), len(self.words) - 1
        for k in range(at, len(words)):
            if final in now:
                return True
            after = {s for n in now if (s := self.words[n].get(words[k])) is not None} | {s for n in now if (s := self.free[n]) is not None}
            if not after:
                return False
            now = self.closure(after)
        return final in now


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of a template. Its anchor is the longest stretch of mandatory words without markup between them."""
    out = Automaton(label)
    now, opened, run, best = out.state(), [], [], []
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|(?:(?!\[\[|\]\]|\{\{).)+", template, re.S):
        if token == "[[":
            best, run = max(best, run, key=len), []
            opened.append(now)
            now = out.state()
            out.skip[opened[-1]].append(now)
        elif token == "]]":
            end = out.state()
            out.skip[now].append(end)
            out.skip[opened.pop()].append(end)
            now = end
        elif token.startswith("{{"):
            best, run = max(best, run, key=len), []
            starts = [now]
            for _ in range(int(token[2:-2])):
                after = out.state()
                out.free[now] = after
                starts.append(now := after)
            end = out.state()
            for s in starts:
                out.skip[s].append(end)
            now = end
        else:
            for word in words_of(token):
                after = out.state()
                out.words[now][word] = after
                now = after
                if not opened:
                    run.append(word)
    if opened:
        raise ValueError(f"{label}: an optional region is not closed")
    out.anchor = max(best, run, key=len)
    if not out.anchor:
        raise ValueError(f"{label}: no mandatory word")
    out.first = frozenset(w for s in out.closure({0}) for w in out.words[s])
    if any(out.free[s] is not None for s in out.closure({0})):
        raise ValueError(f"{label}: begins with a replaceable region")
    return out


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """All words where the phrase starts."""
    out, at, n = [], -1, len(phrase)
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + n] == phrase:
                out.append(at)
    except ValueError:
        return out


def scan_text(text: str | None, automata: list[Automaton], phrases: dict[str, str]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of a text."""
    words = words_of(text)
    if not words:
        return 0, 0, None, None, "", "", 0.0
    has = set(words)
    starts, base = [], set()
    for phrase, label in phrases.items():
        wanted = words_of(phrase)
        if wanted and has.issuperset(wanted) and (found := places(words, wanted)):
            starts += found
            base.add(label)
    labels = set()
    for a in automata:
        if has.issuperset(a.anchor) and places(words, a.anchor) and any(a.accepts_at(words, k) for k, w in enumerate(words) if w in a.first):
            labels.add(a.label)
    score = 1.0 if labels else 0.5 if base else 0.0
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row of docs(doc_id, text).

    Base labels are those of phrases whose words stand consecutively; n_base counts all their places. labels adds the templates that accept a stretch of
    the text. score is 1 if one does, else 0.5 if there is a base label, else 0. Null and empty texts have no words and no labels; repeated rows each
    give a row; an empty table gives none. Other columns are not read. Whole texts are scanned, one at a time; nothing is shuffled."""
    C.arrow_batches(docs.sparkSession, 500)
    phrases = PHRASES if phrases is None else phrases
    automata = [compile_template(k, t) for k, t in (TEMPLATES if templates is None else templates).items()]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t.as_py(), automata, phrases) for t in batch.column(1)]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
