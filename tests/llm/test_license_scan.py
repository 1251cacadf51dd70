from sigloom.llm.license_scan import TEMPLATES, Scanner, license_blocks, words_of


def test_every_template_is_found_whole():
    scanner = Scanner(TEMPLATES)
    for name, text in TEMPLATES.items():
        assert scanner.rank(text)[0][1] == name
        assert [x[2] for x in scanner.scan(text)] == [name]


def test_what_dictionaries_save_decides(monkeypatch):
    scanner = Scanner(TEMPLATES)
    text = f"Intro. {TEMPLATES['MIT whole']} Outro."
    assert [x[2] for x in scanner.scan(text)] == ["MIT whole"]
    rank = scanner.rank
    monkeypatch.setattr(scanner, "rank", lambda block: rank(block)[::-1])
    assert [x[2] for x in scanner.scan(text) if x[2]][:1] == ["MIT"]
    monkeypatch.setattr(scanner, "saved", lambda block, names: dict.fromkeys(names, 0.0))
    monkeypatch.setattr(scanner, "rank", rank)
    assert [x[2] for x in scanner.scan(text) if x[2]][:1] == ["MIT"]  # nothing saved: by name


def brute(text, templates, allowed=0.2):
    """The best-ranked template of which any run of words of the text is a wording, for a text that is one block."""
    scanner, own = Scanner(templates), words_of(text)
    fits = set()
    for name, want in scanner.words.items():
        most = int(allowed * len(want))
        for i in range(len(own)):
            for j in range(i + 1, min(len(own), i + len(want) + most) + 1):
                # Longest common subsequence of words, by the table.
                row = [0] * (len(want) + 1)
                for w in own[i:j]:
                    last = row[:]
                    for k, x in enumerate(want):
                        row[k + 1] = last[k] + 1 if w == x else max(row[k], last[k + 1])
                common = row[-1]
                if len(want) - common + (j - i) - common <= most:
                    fits.add(name)
    return next((name for _, name in scanner.rank(text) if name in fits), None)


def test_small_texts_against_brute_force():
    templates = {"alpha": "permission is given to any person to use the alpha work", "alpha long": "permission is given to any person to use the alpha work and to sell copies of it", "beta": "redistribution of the beta work in any form is allowed"}
    scanner = Scanner(templates)
    base = list(templates.values())
    texts = [f"so {base[0]} ends", f"so {base[1]} ends", f"x {base[2]} y", base[1].replace("sell", "give"), base[0].replace("any person", "all"),
             base[2].replace("beta", "gamma").replace("form", "shape"), base[1].replace("and to sell", ""), "permission is given to nobody here today"]
    for text in texts:
        found = [x[2] for x in scanner.scan(text) if x[2]]
        assert found[:1] == [x for x in [brute(text, templates)] if x], text


def test_a_further_clause_is_known_by_its_words():
    scan = lambda t: [x[2] for x in Scanner(TEMPLATES).scan(t) if x[2]]
    assert scan(f"{TEMPLATES['BSD-2-Clause']} We neither ship nor endorse builds of it.") == ["BSD-2-Clause"]
    assert scan(f"{TEMPLATES['BSD-2-Clause']} 3. {TEMPLATES['BSD-3-Clause'].split('3. ')[1].replace('contributors', 'friends and the many helpers')}") != ["BSD-2-Clause"]


def test_wording_and_versions():
    scanner = Scanner(TEMPLATES)
    scan = lambda t: [x[2] for x in scanner.scan(t)]
    assert scan("Released under the MIT License") == ["MIT notice"]
    assert scan("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0 notice"]
    assert scan("This work is licensed under the GNU General Public License, version 9.") == [None]
    assert scan("Driving licences are issued to any person who asks for a copy of the form.") == [None]
    assert scan(TEMPLATES["MIT"].replace("publish, distribute", "publish or distribute")) == ["MIT"]
    wrapped = "\n".join(" ".join(words) for words in [TEMPLATES["BSD-2-Clause"].split()[i : i + 9] for i in range(0, 80, 9)])
    assert scan(f"Intro line\n\n{wrapped}\nend") == ["BSD-2-Clause"]
    two = "Released under the MIT License.\nLicensed under CC BY-NC 4.0."
    assert scan(two) == ["MIT notice", "CC-BY-NC-4.0 notice"]


def test_a_license_inside_a_long_line():
    scanner = Scanner(TEMPLATES)
    prose = lambda k: " ".join(f"w{i * 7919 % 5003}x{k}" for i in range(7000))
    for name in ("MIT", "BSD-3-Clause", "MIT notice"):
        text = f"{prose(1)} {TEMPLATES[name]} {prose(2)}"
        assert len(text) > 100_000
        found = [x for x in scanner.scan(text) if x[2]]
        assert [x[2] for x in found] == [name]
        assert words_of(text[found[0][0] : found[0][1]]) == words_of(TEMPLATES[name])


def test_lines_without_a_cue_and_shared_lines():
    scan = lambda t: [x[2] for x in Scanner(TEMPLATES).scan(t) if x[2]]
    header = (
        "// This Source Code Form is subject to the terms of the Mozilla Public\n"
        "// License, v. 2.0. If a copy of the MPL was not distributed with this\n"
        "// file, You can obtain one at http://mozilla.org/MPL/2.0/.\n"
    )
    assert scan(f"#include <x>\n{header}int main;") == ["MPL-2.0"]
    assert scan("\n".join(TEMPLATES["MIT"].split())) == ["MIT"]
    prose = " ".join(f"w{i}" for i in range(3000))
    assert scan(f"{prose} {TEMPLATES['MIT']} {prose} Licensed under CC BY 4.0. {prose}") == ["MIT", "CC-BY-4.0 notice"]
    assert scan("Released under the MIT License. Licensed under CC BY 4.0.") == ["MIT notice", "CC-BY-4.0 notice"]


def test_deciding_words():
    scan = lambda t: [x[2] for x in Scanner(TEMPLATES).scan(t) if x[2]]
    assert scan("Licensed under CC BY-ND 4.0.") == ["CC-BY-ND-4.0 notice"]
    assert scan(TEMPLATES["CC-BY-4.0"].replace("Attribution", "Attribution-NonCommercial")) == ["CC-BY-NC-4.0"]
    assert scan(TEMPLATES["GPL-3.0-or-later"].replace("GNU", "GNU Affero")) == ["AGPL-3.0-or-later"]
    assert scan(TEMPLATES["GPL-3.0-or-later"].replace("GNU", "GNU Lesser")) == ["LGPL-3.0-or-later"]
    assert scan(TEMPLATES["GPL-3.0-or-later"].replace(", or (at your option) any later version", " only")) == []
    assert scan(TEMPLATES["BSD-4-Clause"]) == ["BSD-4-Clause"]
    assert scan(TEMPLATES["BSD-4-Clause whole"].replace("mentioning features or use of", "about")) == ["BSD-4-Clause whole"]
    other = TEMPLATES["BSD-4-Clause"].replace("software developed", f"software {'made and then kept ' * 20}developed")
    assert "BSD-2-Clause" not in scan(other)
    assert scan(f"{TEMPLATES['MIT whole']}\n{TEMPLATES['BSD-3-Clause whole']}") == ["MIT whole", "BSD-3-Clause whole"]


def test_documents(spark, odd_docs, sf, no_docs):
    docs = odd_docs.unionByName(spark.read.parquet(f"{sf}/documents.parquet"), allowMissingColumns=True)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = license_blocks(docs).collect()
    exact = {(r.doc_id, r.license) for r in got if r.license}
    for doc_id, text in texts.items():
        for line in (text or "").split("\n"):
            for name, template in TEMPLATES.items():
                if words_of(line) == words_of(template):
                    assert (doc_id, name) in exact
    for r in got:
        block = texts[r.doc_id][r.start : r.end]
        assert block and 0 <= r.saved <= 1
        if r.license:
            want = words_of(TEMPLATES[r.license])
            assert len(r.missing) + len(r.extra) <= 0.2 * len(want)
            assert set(want) - set(words_of(block)) <= set(r.missing)
    assert license_blocks(no_docs).count() == 0
