"""Licence scans by template markup.

A template is a text with marked regions, in the notation that licence lists
use: ``<<beginOptional>> ... <<endOptional>>`` may be absent, and
``<<var;name=N;words=A-B>>`` stands for A to B words of any kind, while
``<<var;name=N;one=x|y z>>`` stands for one of the wordings given. Templates
are compiled into automata over words. A text matches where its words run
through an automaton from the first word to the last: the mandatory wording has
to be there exactly, in order, with nothing else in between.
"""

import re

import pyarrow as pa
from pyspark.sql import types as T

from .common import bounded_batches, raw_text

# Words are runs of 0-9, A-Z (lower-cased), a-z and all that is not ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))

#: Phrases that are counted wherever their words stand one after the other.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_MIT_GRANT = """permission is hereby granted free of charge to any person obtaining a copy of
 <<var;name=work;one=this software and associated documentation files|this software>>
 <<beginOptional>>the software<<endOptional>> to deal in the software without restriction including
 without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
 of the software and to permit persons to whom the software is furnished to do so subject to the following
 conditions"""
_BSD_GRANT = """redistribution and use in source and binary forms with or without modification are permitted
 provided that the following conditions are met"""

#: (label, template). Every template begins with mandatory words.
TEMPLATES = (
    ("apache-2.0", """licensed under the apache license version 2 0
     <<beginOptional>>the license you may not use this file except in compliance with the license
     <<endOptional>>"""),
    ("cc-by-family", """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>>
     <<var;name=family;one=cc by|creative commons attribution>>
     <<var;name=terms;one=nc sa|nc nd|nc|nd|sa|noncommercial|sharealike|noderivs|noderivatives>>
     <<beginOptional>><<var;name=version;one=1 0|2 0|2 5|3 0|4 0>><<endOptional>>"""),
    ("cc-by-plain", """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>>
     <<var;name=family;one=cc by|creative commons attribution>>
     <<var;name=version;one=1 0|2 0|2 5|3 0|4 0>>"""),
    ("cc0-1.0", "released under <<beginOptional>>the<<endOptional>> <<var;name=name;one=cc0|cc0 1 0>>"),
    ("gpl-notice", """licensed under the <<beginOptional>>terms of the<<endOptional>>
     <<beginOptional>>gnu<<endOptional>> general public license
     <<beginOptional>>version <<var;name=version;one=1|2|3|2 0|3 0>>
     <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>><<endOptional>>"""),
    ("gpl-program", """this program is free software you can redistribute it and or modify it under the terms of
     the gnu <<beginOptional>>lesser<<endOptional>> general public license as published by the free software
     foundation either version <<var;name=version;words=1-2>> of the license or at your option any later version"""),
    ("mit", """released under the <<beginOptional>>terms of the<<endOptional>> mit license"""),
    ("mit", "licensed under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("mit", _MIT_GRANT),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is
     hereby granted provided that the above copyright notice and this permission notice appear in all copies"""),
    ("bsd", _BSD_GRANT),
    ("reserved-by", """copyright <<beginOptional>>c<<endOptional>> <<var;name=holder;words=1-12>>
     all rights reserved"""),
)


def tokens_of(template):
    """Nested list of a template: words, ('any', low, high), ('one', wordings), ('optional', list)."""
    stack = [[]]
    for mark, words in re.findall(r"<<(.*?)>>|([^<]+)", template, re.S):
        if words:
            stack[-1] += words.encode().translate(_FOLD).split()
        elif mark == "beginOptional":
            stack.append([])
        elif mark == "endOptional":
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        else:
            fields = dict(part.split("=", 1) for part in mark.split(";")[1:])
            if "one" in fields:
                stack[-1].append(("one", [w.encode().translate(_FOLD).split() for w in fields["one"].split("|")]))
            else:
                low, _, high = fields["words"].partition("-")
                stack[-1].append(("any", int(low), int(high or low)))
    if len(stack) != 1:
        raise ValueError("optional regions of a template do not nest")
    if not stack[0] or not isinstance(stack[0][0], bytes):
        raise ValueError("a template has to begin with mandatory words")
    return stack[0]


class Automaton:
    """Automaton over words without empty steps: per state {word: states}, any-word states, end or not."""

    def __init__(self, template):
        tree = tokens_of(template)
        self.lead = b" ".join(self._lead(tree))
        self.words, self.any, self.empty = [{}], [set()], [set()]
        end = self._build(tree, 0)
        closed = [self._closure(s) for s in range(len(self.words))]
        self.accepts = [end in c for c in closed]
        self.steps = []
        for c in closed:
            step, anything = {}, set()
            for state in c:
                anything |= self.any[state]
                for word, to in self.words[state].items():
                    step.setdefault(word, set()).update(to)
            self.steps.append((step, anything))

    @staticmethod
    def _lead(tree):
        lead = []
        for item in tree:
            if not isinstance(item, bytes):
                break
            lead.append(item)
        return lead

    def _state(self):
        self.words.append({})
        self.any.append(set())
        self.empty.append(set())
        return len(self.words) - 1

    def _word(self, at, word):
        to = self._state()
        self.words[at].setdefault(word, set()).add(to)
        return to

    def _build(self, tree, at):
        for item in tree:
            if isinstance(item, bytes):
                at = self._word(at, item)
            elif item[0] == "optional":
                inner, after = self._build(item[1], at), self._state()
                self.empty[at].add(after)
                self.empty[inner].add(after)
                at = after
            elif item[0] == "one":
                after = self._state()
                for wording in item[1]:
                    last = at
                    for word in wording:
                        last = self._word(last, word)
                    self.empty[last].add(after)
                at = after
            else:
                ends = []
                for count in range(item[2]):
                    if count >= item[1]:
                        ends.append(at)
                    to = self._state()
                    self.any[at].add(to)
                    at = to
                after = self._state()
                for end in [*ends, at]:
                    self.empty[end].add(after)
                at = after
        return at

    def _closure(self, state):
        found, todo = {state}, [state]
        while todo:
            for to in self.empty[todo.pop()] - found:
                found.add(to)
                todo.append(to)
        return found

    def longest(self, words, start):
        """Last word of the longest match that begins at ``start``, or None."""
        states, best = {0}, None
        for at in range(start, len(words)):
            word, following = words[at], set()
            for state in states:
                step, anything = self.steps[state]
                following |= anything
                following |= step.get(word, set())
            if not following:
                break
            states = following
            if any(self.accepts[s] for s in states):
                best = at
        return best


def places(joined, phrase):
    """Word positions of all places of a phrase in blank-separated words with blanks around them."""
    found, at, counted, words = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        words += joined.count(b" ", counted, at)
        counted = at
        found.append(words)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return found


def scan_text(raw, base, automata):
    """(n_words, base places, base labels, spans): spans are (label, first word, last word)."""
    words = raw.translate(_FOLD).split()
    joined = b" " + b" ".join(words) + b" "
    starts, labels = [], set()
    for phrase, label in base:
        here = places(joined, phrase)
        if here:
            starts += here
            labels.add(label)
    spans = set()
    for label, automaton in automata:
        for start in places(joined, automaton.lead):
            last = automaton.longest(words, start)
            if last is not None:
                spans.add((label, start, last))
    return len(words), starts, labels, sorted(spans, key=lambda s: (s[1], s[2], s[0]))


SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("first", T.LongType()),
        T.StructField("last", T.LongType())])))])


def scan_licenses(docs, text="text", keep=("doc_id",), base=BASE, templates=TEMPLATES):
    """Licence phrases and templates of every text.

    ``keep`` columns, then: n_words; n_base, first_word and last_word over all
    places of base phrases (null without any); sorted distinct base_labels and
    labels (base and templates); score, 1 - 1/2^n for n places of phrases plus
    labels of templates; spans, the longest match from each place where a
    template begins. One row per row; a null text is an empty one: no words,
    no labels, score 0.
    """
    bounded_batches(docs.sparkSession)
    base = [(p.encode().translate(_FOLD).strip(), label) for p, label in base]

    def run(batches):
        automata = [(label, Automaton(template)) for label, template in templates]
        for batch in batches:
            rows = []
            for raw in batch.column(len(keep)).to_pylist():
                count, starts, base_labels, spans = scan_text(raw, base, automata)
                extra = {s[0] for s in spans}
                rows.append({
                    "n_words": count, "n_base": len(starts),
                    "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                    "base_labels": sorted(base_labels), "labels": sorted(base_labels | extra),
                    "score": 1 - 0.5 ** min(50, len(starts) + len(extra)),
                    "spans": [{"label": a, "first": b, "last": c} for a, b, c in spans]})
            found = pa.array(rows, _SPAN_TYPE)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found.flatten()],
                                             names=[*keep, *[f.name for f in SCHEMA]])

    rows = docs.select(*keep, raw_text(text).alias("_raw"))
    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in keep], *SCHEMA]))


_SPAN_TYPE = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])))])


def pattern_of(template):
    """The template as a regular expression over words that are each followed by a blank."""
    def write(tree):
        out = ""
        for item in tree:
            if isinstance(item, bytes):
                out += item.decode() + " "
            elif item[0] == "optional":
                out += f"(?:{write(item[1])})?"
            elif item[0] == "one":
                out += "(?:" + "|".join(write(w) for w in item[1]) + ")"
            else:
                out += f"(?:[^ ]+ ){{{item[1]},{item[2]}}}"
        return out
    return " " + write(tokens_of(template))
