"""License scan: a trained paragraph classifier, applied by SQL functions alone.

A multinomial logistic regression over word n-grams is trained on the driver
from the templates and names below, their parts, texts of licences that have no
family here, and plain sentences; that takes a second and depends on no data.
Its probabilities, the unknown class included, are calibrated on templates and
phrases that were left out whole. The weights are a table of bounded size, one
row for each n-gram. Documents are cut into paragraphs (see ``BREAK``), wrapped
lines being one; every paragraph is split into n-grams, joined with the weights,
and gets a family, or ``unknown`` where the calibrated probability is below a
limit; n-grams that training has not seen count nothing, so a licence sentence
is found in a long paragraph too. A comparison with the templates of that family
confirms it. No gate stands before the classifier; a paragraph that it names no
family for gets a row only where it has a cue word.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

#: Characteristic passages of each family, as published.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This program is free software: you can redistribute it and/or modify",
    ],
    "lgpl": [
        "This work is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc.",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program.",
        "If your software can interact with users remotely through a computer network, you should also make sure that it provides a way for users to get its source.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.",
    ],
    "bsl-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "All rights granted under the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "To view a copy of this license, visit https://creativecommons.org/licenses/by/4.0/",
        "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International license.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "To view a copy of this license, visit https://creativecommons.org/licenses/by-sa/4.0/",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "To view a copy of this license, visit https://creativecommons.org/licenses/by-nc/4.0/",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "licensed under https://creativecommons.org/licenses/by-nc-sa/4.0/",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "To view a copy of this license, visit https://creativecommons.org/licenses/by-nd/4.0/",
    ],
    "public-domain": [
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "licensed under https://creativecommons.org/publicdomain/zero/1.0/",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright by the author. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, stored in a retrieval system, or transmitted in any form without the prior written permission of the publisher.",
    ],
}

#: Names of the families, for the phrases below.
NAMES: dict[str, list[str]] = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache 2.0 License", "Apache"],
    "mit": ["MIT License", "MIT", "MIT licence", "Expat License", "MIT/X11 License"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License", "GNU GPL", "GPLv3", "GPLv2", "GPL-3.0-or-later", "GPL-2.0-only", "GPL", "GNU/GPL"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "GNU LGPL", "LGPLv2.1", "LGPL-2.1-or-later", "LGPL"],
    "agpl": ["GNU Affero General Public License, version 3", "GNU Affero General Public License", "GNU AGPL", "AGPLv3", "AGPL-3.0-only", "AGPL"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "BSD-3-Clause", "BSD-2-Clause", "BSD"],
    "mpl-2.0": ["Mozilla Public License 2.0", "Mozilla Public License", "MPL 2.0", "MPL-2.0"],
    "isc": ["ISC License", "ISC"],
    "bsl-1.0": ["Boost Software License 1.0", "Boost Software License", "BSL-1.0"],
    "zlib": ["zlib License", "zlib/libpng License", "Zlib"],
    "epl": ["Eclipse Public License 2.0", "Eclipse Public License", "EPL-2.0", "EPL"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial 4.0 License"],
    "cc-by-nd": ["CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 License"],
    "public-domain": ["CC0 1.0", "CC0-1.0", "Unlicense", "Creative Commons Zero"],
    "unknown": ["PostgreSQL License", "Vim License", "OpenSSL License", "Microsoft Public License", "Python Software Foundation License", "Open Font License", "same terms as Perl itself", "private agreement", "commercial agreement", "Acme End User License", "terms of the company", "following license", "Affiliate Licensing Program", "Liquor License", "new contract", "General Public Transport Act", "Town Public Library rules"],
}

#: What is said around such a name.
PHRASES = ["Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "This software is available under {}.", "This project uses the {} license.", "SPDX-License-Identifier: {}", "License: {}", "{}", "Made available under {} by its authors.", "This file is covered by the {}; see the file LICENSE."]

#: Licences that have no family here, and sentences that grant nothing.
OTHERS = [
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1. The fonts and derivatives, however, cannot be released under any other type of license.",
    "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software.",
    "This End User License Agreement is a legal agreement between you and the company for the software product. By installing, copying, or otherwise using the product, you agree to be bound by the terms of this agreement.",
    "You may not reverse engineer, decompile, or disassemble the software, or rent, lease or lend it to any person.",
    "The software is licensed, not sold. You may install and use one copy of the software on a single computer.",
    "This material may be copied for classroom use only; any other use needs the permission of the publisher.",
    "Copyright 2019 by the authors.", "See the file COPYING for the terms of use.",
    "He renewed the license of his car at the town office.", "A driving license is required for the job.",
    "The board revoked her license to practise medicine.", "The copyright debate went on for years in the press.",
    "They left without permission and came back late.", "The warranty of the machine ended last year.",
    "The fishing license costs five pounds a year.", "The committee granted permission to build the bridge.",
    "Copyright law differs from country to country.", "The tax was meant to redistribute wealth among the regions.",
    "Poetic license is allowed in such a song.", "The house was sold with a warranty deed.",
    "No permission was asked of the owner of the land.", "His licensed premises close at eleven.",
    "The public domain of knowledge grows every year.", "Please ask for a licence before you use the hall.",
    "The company licensed its name to a shoe maker.", "Commercial license terms are available on request from the vendor.",
    "The library is free and open to the general public.", "The software was written for a bank and sold to others.",
    "The foundation was published as a work of fiction.", "An apache helicopter landed by the river.",
    "He studied at MIT and worked in Boston.", "The rights of the workers were reserved for a later talk.",
    "All people have rights, and all of them are equal.", "The source code of the program was lost in a fire.",
]

#: Plain sentences, in whose words alone no n-gram counts.
PLAIN = [
    "There is a house by the river, and with it goes all of the land that can be seen from here.", "This is the work of a man who had either no time or no wish to do more.", "You may not see it at first, but the list is in the book for any one to use.",
    "She was released from the hospital and is now at home with her family.", "The source of the river is under the hill; the following day they went on.", "We have a copy of the letter, which was sent to all of them in 2004.",
    "It was written by the same person and is subject to change as or when it has to be.", "If you are not there, no part of the work will be done.", "The public library is open for general use and free to all.", "He made a note of the rights and wrongs of the case, to that person or those at the event without use.",
    "Er kam mit dem Zug und ging mit ihr in die Stadt.", "Mit der Zeit ist das von den Leuten vergessen worden, zu ein.",
    "Elle est dans la maison de la rue et que les gens ne le voient pas, des un une en par aux.", "El hombre que vive en la casa de la esquina no es de aqui y se va con los otros por un.",
]

#: A paragraph with any of these gets a row even where no family is
#: named; they keep no paragraph from the classifier.
CUES = ["licen", "copyright", "permission", "warrant", "redistribut", "public domain", "publicdomain", "creative commons", "creativecommons", "gnu ", "gnu/", "gpl", "rights reserved", "cc by", "cc-by", "spdx", "apache", "bsd"]

WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"

#: Where a paragraph ends: at a blank line, or at a line feed behind the end of a
#: sentence. Other line feeds only wrap it.
BREAK = r"\n[ \t\r]*\n|(?<=[.!?:;])[ \t\r]*\n"


@dataclass(frozen=True)
class Scan:
    """``unknown`` is the least probability of a family that is named, ``similar``
    the least overlap with a template that confirms it. ``folds`` is the number
    of parts that templates and phrases are left out in for the calibration."""

    orders: int = 3
    unknown: float = 0.6
    similar: float = 0.5
    epochs: int = 400
    folds: int = 3


def tokens(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def n_grams(text: str, orders: int) -> set[str]:
    w = tokens(text)
    return {" ".join(w[i : i + k]) for k in range(1, orders + 1) for i in range(len(w) - k + 1)}


def examples(p: Scan = Scan()) -> tuple[list[str], np.ndarray, np.ndarray, list[str]]:
    """Texts, the shares of the classes in each, its fold, and the names of the classes.

    Class 0 is other text. Templates are taken whole and in windows of their
    words; a window that several families have in common belongs to each of
    them in part. What stems from one template, and what stems from one phrase,
    is in one fold.
    """
    names = ["unknown", *TEMPLATES]
    whole = [(t, c, k) for c, f in enumerate(names[1:], 1) for k, t in enumerate(TEMPLATES[f])]
    whole += [(t, 0, k) for k, t in enumerate([*OTHERS, *PLAIN])]
    flat = [(" " + " ".join(tokens(t)) + " ", c) for t, c, _ in whole]
    texts, shares, folds = [], [], []

    def add(text: str, classes: list[int], fold: int) -> None:
        share = np.zeros(len(names))
        share[classes] = 1 / len(classes)
        texts.append(text)
        shares.append(share)
        folds.append(fold % p.folds)

    for t, c, k in whole:
        w = t.split()
        add(t, [c], k)
        size = max(8, len(w) // 3)
        for i in range(0, len(w) - size + 1 if len(w) > size else 0, max(1, size // 2)):
            part = " ".join(w[i : i + size])
            inside = " " + " ".join(tokens(part)) + " "
            add(part, sorted({x for f, x in flat if inside in f} | {c}), k)
    for c, name in enumerate(names):
        for n in NAMES.get(name, []):
            for k, phrase in enumerate(PHRASES):
                add(phrase.format(n), [c], k)
    return texts, np.array(shares), np.array(folds), names


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@functools.lru_cache(maxsize=4)
def train(p: Scan = Scan()) -> dict:
    """Weights by n-gram, biases, and a scale and shift fitted on left-out folds.

    Full-batch gradient steps on the binary presence of n-grams with an L2
    penalty, for which all updates lie in the span of the examples, so that the
    steps run on their inner products; families count alike however many
    examples they have. N-grams of plain words alone are left out: they tell
    nothing, and long paragraphs are full of them. ``scale`` multiplies all
    scores and ``shift`` is added to that of the unknown class; they are the
    pair with the least log loss on examples whose template or phrase the fit
    had not seen.
    """
    texts, y, folds, names = examples(p)
    plain = {w for t in PLAIN for w in tokens(t)}
    own = [sorted(g for g in n_grams(t, p.orders) if not plain.issuperset(g.split())) for t in texts]
    grams = sorted(set().union(*own))
    at = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(texts), len(grams)))
    for row, g in enumerate(own):
        x[row, [at[k] for k in g]] = 1 / np.sqrt(max(1, len(g)))
    inner = x @ x.T
    # families count alike, and other text as much as four of them
    prior = np.array([4.0] + [1.0] * (len(names) - 1)) / (len(names) + 3)

    def fit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, t = inner[np.ix_(rows, rows)], y[rows]
        weight = (t / np.maximum(t.sum(0), 1e-9) * prior).sum(1, keepdims=True) * len(rows)
        a, b = np.zeros(t.shape), np.zeros(len(names))
        for _ in range(p.epochs):
            g = (softmax(k @ a + b) - t) * weight / len(rows)
            a -= 4.0 * (g + 3e-4 * a)
            b -= 0.5 * g.sum(0)
        return a, b

    z, held = [], []
    for f in range(p.folds):
        rows, out = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
        a, b = fit(rows)
        z.append(inner[np.ix_(out, rows)] @ a + b)
        held.append(out)
    z, held = np.concatenate(z), np.concatenate(held)

    def loss(scale: float, shift: float) -> float:
        moved = scale * z
        moved[:, 0] += shift
        return float(-(y[held] * np.log(softmax(moved) + 1e-12)).sum(1).mean())

    scale, shift = min(((s, d) for s in np.linspace(0.25, 6, 24) for d in np.linspace(-2, 4, 25)), key=lambda v: loss(*v))
    a, b = fit(np.arange(len(texts)))
    return {"names": names, "grams": grams, "weights": x.T @ a, "bias": b, "scale": float(scale), "shift": float(shift), "held": (z, y[held])}


def paragraphs(text: str | None) -> list[str]:
    """The paragraphs of a text, lower-cased, in Python; SQL does the same."""
    return re.split(BREAK, (text or "").lower())


def pairs(text: str) -> set[str]:
    w = tokens(text)
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def scanned(documents: DataFrame, p: Scan = Scan()) -> DataFrame:
    """One row for each paragraph that a family is named for or that has a cue word.

    (doc_id, paragraph, family, probability, similarity, confirmed): the number
    of the paragraph from 0, the family or ``unknown``, its calibrated
    probability, the best overlap with a template of the family (distinct pairs
    of words that both have, over those of the template or all pairs of the
    paragraph, whichever are fewer), and whether that confirms it. Between
    families of equal score the first in the order of ``TEMPLATES`` is taken; a
    probability or similarity equal to its limit passes. Null and empty texts
    have no such paragraph, an empty table gives an empty result. Long texts are
    cut into paragraphs like others; one of many words is one row, whose work
    grows with its length. Rows that repeat are scanned each for itself. Other
    columns are ignored, whatever their names.

    Rows are told apart by id and two hashes of the text, which a task that
    runs again finds again, whatever order its rows come in.
    """
    spark = documents.sparkSession
    model = train(p)
    names = model["names"]
    # the pairs of words of all templates have a bit each, in words of 63 bits
    bits = {g: i for i, g in enumerate(sorted(set().union(*(pairs(t) for ts in TEMPLATES.values() for t in ts))))}
    n_words = -(-len(bits) // 63)
    at = {g: i for i, g in enumerate(model["grams"])}
    none = [0.0] * len(names)
    rows = [{"gram": "", "known": 0, "w": none, "slot": -1, "bit": 0}]
    for g in sorted(at.keys() | bits.keys()):
        w = [round(float(v), 6) for v in model["weights"][at[g]]] if g in at else none
        rows.append({"gram": g, "known": int(g in at), "w": w, "slot": bits[g] // 63 if g in bits else -1, "bit": 1 << bits[g] % 63 if g in bits else 0})
    table = store.lines_table(spark, rows, "gram string, known int, w array<double>, slot int, bit long", "weights")
    own = documents.select("doc_id", "text").where(F.length("text") > 0)
    own = own.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.split(F.lower("text"), BREAK).alias("parts"))
    lines = own.select("doc_id", "h1", "h2", F.posexplode("parts").alias("paragraph", "line"))
    lines = lines.select("doc_id", "h1", "h2", "paragraph", reduce(or_, [F.col("line").contains(c) for c in CUES]).alias("cue"), F.expr(f"regexp_extract_all(line, '{WORD}', 0)").alias("words"))
    # words that no n-gram of the table has become null, and with them what they are part of
    ours = sorted({w for r in rows for w in r["gram"].split()})
    key = ["doc_id", "h1", "h2", "paragraph", "cue", "n_pairs"]
    known = lines.select(*key[:-1], (F.size("words") - 1).alias("n_pairs"), F.transform("words", lambda w: F.when(w.isin(ours), w)).alias("ours"))
    # get() takes one element; slice() would copy the whole array for each word
    tails = lambda k: "".join(f", ' ', get(ours, i + {j})" for j in range(1, k))
    several = lambda k: F.array_compact(F.expr(f"transform(ours, (w, i) -> concat(w{tails(k)}))"))
    made = F.array_distinct(F.flatten(F.array(F.array_compact("ours"), *(several(k) for k in range(2, p.orders + 1)))))
    # the empty n-gram is that of the paragraph itself, and tells how often its
    # row occurs; paragraphs without any word of the table need none
    made = F.when(F.size(F.array_compact("ours")) > 0, F.concat(F.array(F.lit("")), made)).when(F.col("cue"), F.array(F.lit("")))
    # the outer form: for the inner one Spark infers a filter that would make the
    # n-grams a second time, and the words anew for each of them
    each = known.select(*key, F.explode_outer(made).alias("gram")).where("gram is not null")
    found = each.join(F.broadcast(table), "gram").groupBy(*key).agg(
        F.sum((F.col("gram") == "").cast("int")).alias("n"),
        F.sum("known").alias("known"),
        *(F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(names))),
        *(F.bit_or(F.when(F.col("slot") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(n_words)),
    )
    # repeated rows have added up alike
    root = F.sqrt(F.greatest(F.col("known") / F.col("n"), F.lit(1)))
    z = [F.lit(model["scale"]) * (F.col(f"s{k}") / F.col("n") / root + F.lit(float(model["bias"][k]))) + F.lit(model["shift"] if k == 0 else 0.0) for k in range(len(names))]
    # lambdas and a generator keep the optimiser from making the scores again for each use
    verdict = F.transform(
        F.transform(F.array(F.array(*z)), lambda z: F.struct(z.alias("z"), F.array_max(z).alias("top"))),
        lambda x: F.struct(
            (1 / F.aggregate(x["z"], F.lit(0.0), lambda s, v: s + F.exp(v - x["top"]))).alias("p"),
            F.array_position(x["z"], x["top"]).cast("int").alias("c"),
        ),
    )
    scored = found.select("doc_id", "paragraph", "cue", "n_pairs", "n", *(f"b{k}" for k in range(n_words)), F.explode_outer(verdict).alias("v"))
    scored = scored.where(F.col("cue") | ((F.col("v.c") > 1) & (F.col("v.p") >= p.unknown)))
    scored = scored.withColumn("probability", F.col("v.p")).withColumn("c", F.when(F.col("v.p") < p.unknown, F.lit(1)).otherwise(F.col("v.c")))
    made = []  # for each family its templates, as (pairs, their bits)
    for family in names:
        masks = []
        for t in TEMPLATES.get(family, []):
            mask = [0] * n_words
            for g in pairs(t):
                mask[bits[g] // 63] |= 1 << bits[g] % 63
            masks.append(f"named_struct('size', {len(pairs(t))}, 'mask', array({', '.join(f'{m}L' for m in mask)}))")
        made.append(f"array({', '.join(masks)})" if masks else "cast(array() as array<struct<size: int, mask: array<bigint>>>)")
    both = "aggregate(zip_with(bits, t.mask, (b, m) -> cast(bit_count(b & m) as int)), 0, (x, y) -> x + y)"
    scored = scored.withColumn("bits", F.array(*(f"b{k}" for k in range(n_words))))
    similarity = F.expr(f"coalesce(array_max(transform(element_at(array({', '.join(made)}), c), t -> {both} / least(t.size, greatest(n_pairs, 1)))), 0D)")
    family = F.element_at(F.array(*map(F.lit, names)), F.col("c"))
    out = scored.select("doc_id", "paragraph", family.alias("family"), "probability", similarity.alias("similarity"), "n")
    out = out.withColumn("__again", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return out.select("doc_id", "paragraph", "family", "probability", "similarity", (F.col("similarity") >= p.similar).alias("confirmed"))
