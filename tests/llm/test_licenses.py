import numpy as np

from cueweave.llm import grams, licenses

#: The kinds of license lines in the documents of sf0.1, and lines of other licenses.
LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0-short",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0-line",
    "Released under the MIT License.": "mit-short",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0-short",
    "Licensed under CC BY 4.0.": "cc-by-4.0-line",
    "Licensed under CC BY-SA 4.0.": "cc-by-sa-4.0-line",
    "Licensed under CC BY-NC-ND 4.0.": "cc-by-nc-nd-4.0-line",
    "Licensed under CC0 1.0.": "cc0-1.0-line",
    "This work is licensed under the GNU Lesser General Public License, version 2.1.": "lgpl-2.1-short",
}


def test_each_kind_of_license_line_is_reported_alone():
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    for line, name in LINES.items():
        found = index.matches(f"some words before\n{line}\nand words after", 0.7)
        assert [(m[0], m[1]) for m in found] == [(name, 1.0)]
    assert [m[0] for m in index.matches("Licensed under CC BY-NC 4.0. Other text here. Licensed under CC BY 4.0.", 0.7)] == ["cc-by-nc-4.0-line", "cc-by-4.0-line"]


def test_each_template_is_reported_as_itself():
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        found = {m[0] for m in index.matches(f"before it {text} after it", 0.7)}
        assert name in found and found <= {name, "apache-2.0-short"}


def test_a_whole_license_after_its_own_beginnings():
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    mit = licenses.TEMPLATES["mit"]
    start = " ".join(mit.split()[:8])
    text = f"{start} two others {start} and more {mit} after"
    assert [(m[0], m[1], text[m[2] : m[3]]) for m in index.matches(text, 0.7)] == [("mit", 1.0, mit[:-1])]
    folded = f"İİ ŉa {mit} after"
    assert [(m[0], m[1], folded[m[2] : m[3]]) for m in index.matches(folded, 0.7)] == [("mit", 1.0, mit[:-1])]


def test_matches_against_alignment_at_every_place():
    draw = np.random.default_rng(8)
    vocab = [f"t{i}" for i in range(60)]
    templates = {f"x{k}": " ".join(draw.choice(vocab, int(n))) for k, n in enumerate((12, 25, 60))}
    index = licenses.TemplateIndex(templates)
    full = 0
    for _ in range(150):
        words: list[str] = []
        for _ in range(int(draw.integers(1, 5))):
            words += list(draw.choice(vocab, int(draw.integers(0, 12))))
            copy = templates[f"x{draw.integers(3)}"].split()
            if draw.random() < 0.6:
                for at in draw.choice(len(copy), len(copy) // 10, replace=False):
                    copy[at] = "edit"
            words += copy[: len(copy) if draw.random() < 0.7 else len(copy) // 3]
        text = " ".join(words)
        found = index.matches(text, 0.7)
        ids = index.index.numbers(grams.plain_words(text))
        for k, name in enumerate(index.names):
            template = index.index.ids[k]
            for at in range(-len(template), len(ids)):  # word by word, without gaps
                there = [(i, at + i) for i in range(len(template)) if 0 <= at + i < len(ids) and ids[at + i] == template[i]]
                if len(there) >= 0.85 * len(template):
                    full += 1
                    begin, end = (len(" ".join(words[:j])) for j in (there[0][1], there[-1][1]))
                    assert any(m[0] == name and m[2] <= begin + 1 and m[3] >= end and m[1] >= len(there) / len(template) for m in found)
    assert full > 200
