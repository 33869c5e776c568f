import re

import pytest

from wildgrid.llm import licenses
from wildgrid.llm.licenses import Automaton, pattern_of, scan_licenses, scan_text

AUTOMATA = [(label, Automaton(t)) for label, t in licenses.TEMPLATES]


def labels(text):
    return sorted({s[0] for s in scan_text(text.encode(), [], AUTOMATA)[3]})


def test_templates():
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("Licensed under the Apache License, Version 2.1.") == []
    assert labels("Released under the terms of the MIT License") == ["mit"]
    assert labels("Released under some MIT License") == []
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-family"]
    assert labels("Copyright (c) 2020 Some Body, Inc. All rights reserved.") == ["reserved-by"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-notice"]


def test_regions_against_regular_expressions():
    import itertools

    template = "a b <<beginOptional>>c <<beginOptional>>d<<endOptional>><<endOptional>> <<var;name=n;words=1-2>> <<var;name=o;one=x|y z>>"
    automaton, pattern = Automaton(template), re.compile(pattern_of(template))
    for size in range(3, 8):
        for words in itertools.product("abcxyz", repeat=size - 2):
            words = ["a", "b", *words]
            joined = " " + " ".join(words) + " "
            ends = [m.end() for k in range(len(words), 0, -1)
                    if (m := re.fullmatch(pattern, " " + " ".join(words[:k]) + " "))]
            last = automaton.longest([w.encode() for w in words], 0)
            assert (last is None) == (not ends), joined
            if ends:
                assert len(" " + " ".join(words[:last + 1]) + " ") == ends[0]


def test_template_has_to_begin_with_words():
    with pytest.raises(ValueError):
        Automaton("<<beginOptional>>a<<endOptional>> b")


def test_places_are_counted_one_by_one():
    count, starts, base, _ = scan_text(b"CC-BY cc by! (cc by) ccc by",
                                       [(b"cc by", "cc-by")], [])
    assert (count, starts, base) == (8, [0, 2, 4], {"cc-by"})


def test_odd_rows(odd, empty):
    found = {(r["doc_id"], r["n_words"], r["labels"][0] if r["labels"] else None)
             for r in scan_licenses(odd).collect()}
    assert (3, 0, None) in found and (4, 0, None) in found and scan_licenses(odd).count() == odd.count()
    assert scan_licenses(empty).count() == 0
