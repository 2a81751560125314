"""License scans: MinHash bands over overlapping windows, then exact containment.

Templates are license notices, headers and whole texts, some in several wordings. A text is a row of five-word shingles. For
every size class of templates (powers of two of shingles) it is cut into windows of
twice that size, overlapping so that any stretch of the class's size lies whole within
a window. A window and a template that it holds share a MinHash value with a chance of
at least 0.8 / 2.2 per band; with ``BANDS`` bands of one value a window misses such a
template with a chance below 2 in a million. A retrieved template is verified on the
window's exact shingles: it matches if ``CONTAINED`` of its distinct shingles are there.
Of matches that rest on the same words the one with most of them is reported, so that
between near variants the clause in which they differ decides.

Everything happens where a row is read. Templates are a bounded set, checked by size.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pivotlake.llm.tables import utf8
from pivotlake.llm.words import WordCodes, folded_words, gram_codes, mixed

SHINGLE = 5
CONTAINED = 0.8
BANDS = 32
TEMPLATE_BYTES = 16 << 20

# Wordings of public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "BSD-opening": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

# Further wordings: the license is the name up to "#".
WORDINGS: dict[str, str] = {}

_GNU = (
    "{it} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as "
    "published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
_GNU_ONLY = (
    "{it} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License {version} "
    "as published by the Free Software Foundation."
)
_KINDS = {"GPL-2.0": ("", "2"), "GPL-3.0": ("", "3"), "LGPL-2.1": ("Lesser ", "2.1"), "LGPL-3.0": ("Lesser ", "3"), "AGPL-3.0": ("Affero ", "3")}
for _name, (_kind, _version) in _KINDS.items():
    for _it in ("This program", "This library"):
        for _mark in (":", ";"):
            WORDINGS[f"{_name}-header#{_it}{_mark}"] = _GNU.format(it=_it, mark=_mark, kind=_kind, version=_version)
        WORDINGS[f"{_name}-header#{_it} only"] = _GNU_ONLY.format(it=_it, kind=_kind, version=f"version {_version}")

# Short notices: a verb and a name of the license.
_CALLED = {
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"],
    "CC0-1.0": ["CC0 1.0 Universal", "the Creative Commons CC0 1.0 Universal license"],
    "EPL-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License, Version 2.0"],
    "ISC": ["the ISC License"],
    "MIT": ["the MIT License", "the terms of the MIT License", "an MIT License", "the MIT Open Source License"],
    "MPL-2.0": ["the Mozilla Public License 2.0", "the Mozilla Public License, v. 2.0", "the Mozilla Public License, version 2.0"],
    "Unlicense": ["the terms of the Unlicense"],
}
for _name, (_kind, _version) in _KINDS.items():
    _text = f"the GNU {_kind}General Public License"
    _CALLED[_name] = [f"{_text}{_v}" for _v in (f", version {_version}", f" v{_version}", f" v{_version}.0" if "." not in _version else f" {_version}")]
for _parts, _long in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items():
    _CALLED[f"CC-{_parts}-4.0"] = [f"CC {_parts} 4.0", f"a Creative Commons {_long} 4.0 International License", f"the Creative Commons {_long} 4.0 International License"]
for _name, _all in _CALLED.items():
    for _called in _all:
        for _verb in ("Released", "Distributed", "Licensed", "Published", "Available"):
            WORDINGS[f"{_name}#{_verb} under {_called}"] = f"{_verb} under {_called}"

# Whole texts, without copyright lines.
for _path in sorted(Path(__file__).with_name("license_texts").glob("*.txt")):
    TEMPLATES[f"{_path.stem}-full"] = _path.read_text()

_MULTIPLIERS = np.random.default_rng(3).integers(0, 1 << 63, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = np.random.default_rng(4).integers(0, 1 << 63, BANDS, np.uint64)
CELLS = 1 << 21


def shingles(text: bytes, known: WordCodes) -> np.ndarray:
    """Codes of five-word shingles in text order; a shorter text has none."""
    return mixed(gram_codes(known.of(folded_words(text)), SHINGLE))


class SizeClass:
    """The templates of one size class: their band values as one sorted list of keys."""

    BITS = 20

    def __init__(self, size: int):
        self.size, self.step = size, max(1, size // 2)
        self.reach = -(-2 * size // self.step)
        self.least = 1 << 62
        self._keys: list[tuple[int, int]] = []

    def add(self, template: int, codes: np.ndarray) -> None:
        values = (codes[None] * _MULTIPLIERS[:, None]).min(axis=1) + _SALTS
        self._keys += [(value, template) for value in values.tolist()]
        # A text with fewer shingles than this holds no template of the class.
        self.least = min(self.least, int(np.ceil(CONTAINED * len(codes) - 1e-9)))

    def close(self) -> None:
        self._keys.sort()
        self.keys = [k for k, _ in self._keys]
        self.templates = [t for _, t in self._keys]
        # Whether any key has these last bits; most windows have none.
        self.some = np.zeros(1 << self.BITS, bool)
        self.some[np.array(self.keys, np.uint64) & np.uint64((1 << self.BITS) - 1)] = True

    def met(self, least: np.ndarray) -> set[tuple[int, int]]:
        """(template, window) pairs that share a band value; ``least`` has the band values of
        the blocks of ``step`` shingles, of which a window is ``reach``."""
        window, width = least, 1
        while width < self.reach:
            # Windows at the end are shorter.
            longer = window.copy()
            if width < window.shape[1]:
                np.minimum(window[:, :-width], window[:, width:], out=longer[:, :-width])
            window, width = longer, 2 * width
        keys = window + _SALTS[:, None]
        band, at = np.nonzero(self.some[keys & np.uint64((1 << self.BITS) - 1)])
        found = set()
        for key, place in zip(keys[band, at].tolist(), at.tolist(), strict=True):
            i = bisect_left(self.keys, key)
            while i < len(self.keys) and self.keys[i] == key:
                found.add((self.templates[i], place))
                i += 1
        return found


class Library:
    """Templates by size class and band value."""

    def __init__(self, templates: dict[str, str]):
        known = WordCodes()
        self.names = sorted(templates)
        self.shingles = [np.unique(shingles(templates[n].encode(), known)) for n in self.names]
        # The lengths that a window has to hold, repeated shingles included.
        lengths = [len(shingles(templates[n].encode(), known)) for n in self.names]
        by_size: dict[int, SizeClass] = {}
        for i, (codes, length) in enumerate(zip(self.shingles, lengths, strict=True)):
            if length:
                size = 1 << (length - 1).bit_length()
                by_size.setdefault(size, SizeClass(size)).add(i, codes)
        self.classes = [by_size[size] for size in sorted(by_size)]
        for one in self.classes:
            one.close()

    def matches(self, codes: np.ndarray) -> dict[int, tuple[float, np.ndarray]]:
        """Template -> (containment, places of its shingles in the best window)."""
        found: dict[int, tuple[float, np.ndarray]] = {}
        overlap = 2 * self.classes[-1].size if self.classes else 0
        for first in range(0, len(codes), CELLS // BANDS):
            part = codes[first : first + CELLS // BANDS + overlap]
            # Least band values of ever longer blocks, each made of two of the last ones.
            least, step = part[None] * _MULTIPLIERS[:, None], 1
            for one in self.classes:
                while step < one.step:
                    if least.shape[1] % 2:
                        least = np.concatenate([least, least[:, -1:]], axis=1)
                    least, step = np.minimum(least[:, ::2], least[:, 1::2]), 2 * step
                if len(part) < one.least:
                    continue
                for template, at in sorted(one.met(least)):
                    inside = part[at * one.step : (at + one.reach) * one.step]
                    wanted = self.shingles[template]
                    share = float(np.isin(wanted, inside).mean())
                    if share >= CONTAINED and (template not in found or share > found[template][0]):
                        found[template] = (share, first + at * one.step + np.flatnonzero(np.isin(inside, wanted)))
        return found

    def scan(self, codes: np.ndarray) -> dict[str, tuple[float, int]]:
        """License -> (containment, first word of the best window) for one text's shingles."""
        return self._best(self.matches(codes))

    def _best(self, found: dict[int, tuple[float, np.ndarray]]) -> dict[str, tuple[float, int]]:
        """Without those of which half the places belong to a match with more shingles."""
        kept: list[np.ndarray] = []
        best: dict[str, tuple[float, int]] = {}
        for template, (share, places) in sorted(found.items(), key=lambda x: (-x[1][0] * len(self.shingles[x[0]]), -x[1][0], self.names[x[0]])):
            if all(2 * len(np.intersect1d(places, k)) < len(places) for k in kept):
                kept.append(places)
                name = self.names[template].partition("#")[0]
                best[name] = max(best.get(name, (0.0, 0)), (share, int(places[0])), key=lambda x: x[0])
        return best


_FOUND = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("word", pa.int64())]))


def scanned(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id and found, the licenses in it.

    ``found`` has license, containment (the share of the template's distinct shingles in
    the best window) and word (where the match begins, in words of the folded text),
    by license name. Names are those of ``templates`` up to a "#", after which wordings of
    one license are told apart. Templates of fewer than five words match nothing; null and empty
    texts hold nothing; every row is judged on its own. Other columns are ignored.
    """
    templates = TEMPLATES | WORDINGS if templates is None else templates
    if sum(map(len, templates.values())) > TEMPLATE_BYTES:
        raise ValueError("too many templates for one scan: scan with parts of them and union the results")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, known = Library(templates), WordCodes()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                hits = library.scan(shingles(text, known))
                out.append([{"license": name, "containment": share, "word": word} for name, (share, word) in sorted(hits.items())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _FOUND)], names=["doc_id", "found"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8().alias("text"))
    return rows.mapInArrow(scan, "doc_id bigint, found array<struct<license:string,containment:double,word:bigint>>")
