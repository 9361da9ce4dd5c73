"""Structure of XML files of any form, cut anywhere."""

import random
import xml.etree.ElementTree as ET
from collections import Counter

import pyarrow as pa
import pytest

from kgspark.operators.brackets import _RANGE, TEXT, Range, _fold, element_pairs, structure_of_any
from kgspark.sources.xml_records import scan_nested_records


def plain(text):
    """The pairs by a whole parse of the document."""
    found, stack = Counter(), [None]
    parser = ET.XMLPullParser(["start", "end"])
    parser.feed(text)
    for event, element in parser.read_events():
        if event == "start":
            tag = element.tag.rsplit("}", 1)[-1]
            found[stack[-1], tag] += 1
            stack.append(tag)
        else:
            stack.pop()
    return found


def drawn(draw, depth=0):
    name = draw.choice(["a", "b", "c", "n:d", "e.f-g"])
    value = draw.choice(['"x>y"', "'it\"s > <!-- '".replace("<", "&lt;"), '"/"', "''", '"--"', "']]'"])
    attributes = f" k={value}" * draw.randint(0, 1) + draw.choice(["", " ", "\n"])
    if draw.random() < 0.2:
        return f"<{name}{attributes}/>"
    inside = ["text", "a > b", "--", "]] ", "?", "<!-- <no> > -- -->".replace("-- --", "- --"), "<![CDATA[<no> ]] > \"]]>", "<?p <no> > ?>", "'", '"']
    parts = [drawn(draw, depth + 1) if depth < 6 and draw.random() < 0.6 else draw.choice(inside) for _ in range(draw.randint(0, 5))]
    return f"<{name}{attributes}>{''.join(parts)}</{name}{draw.choice(['', ' '])}>"


def document(seed):
    draw = random.Random(seed)
    kind = draw.choice(["", '<?xml version="1.0"?>\n', "<!DOCTYPE r [<!ELEMENT r (any)> <!-- ]> <x> --> <!ENTITY e 'y>z'>\n]>"])
    return f"{kind}{element(draw, 8)}\n"


def element(draw, size):
    return f'<r xmlns:n="u">{"".join(drawn(draw) for _ in range(size))}</r>'


def by_ranges(text, cuts):
    pieces = text.split(">")
    rows = []
    for block, (a, z) in enumerate(zip([0, *cuts], [*cuts, len(pieces)])):
        part = Range(7, block)
        for piece in pieces[a:z]:
            part.read(piece)
        rows.append(part.row())
    folded = _fold(pa.Table.from_pylist(rows, schema=_RANGE)).to_pylist()
    found = Counter()
    for row, more in zip(rows, folded):
        for pairs in [more["found"], *(row["pairs"][i] for i in more["used"])]:
            for p in pairs:
                found[p["parent"], p["child"]] += p["n"]
    return found


@pytest.mark.parametrize("seed", range(40))
def test_any_cut_gives_the_pairs_of_a_parse(seed):
    text = document(seed)
    wanted = plain(text)
    n = text.count(">") + 1
    draw = random.Random(seed + 1000)
    assert by_ranges(text, []) == wanted
    assert by_ranges(text, range(1, n)) == wanted
    for _ in range(5):
        assert by_ranges(text, sorted(draw.sample(range(1, n), min(5, n - 1)))) == wanted


def test_states_meet():
    """Comments, quotes and sections are left at the same piece by whoever is inside: then one reading goes on."""
    part = Range(1, 100)
    for piece in ['<a k="v"', "x'</a", "b--", "c]]", "d?", "]", "<e"]:
        part.read(piece)
    assert TEXT in part.now and len(part.now) < 8


def test_files_at_one_and_many_splits(spark, small_splits, tmp_path):
    wanted = {}
    for seed in range(100, 106):
        draw = random.Random(seed)
        text = f"<all>{''.join(element(draw, 9) for _ in range(6))}</all>"
        (tmp_path / f"f{seed}.xml").write_text(text)
        wanted |= {(f"f{seed}.xml", *pair): n for pair, n in plain(text).items()}
    (tmp_path / "other.txt").write_text("<no><x/></no>")
    (tmp_path / "empty.xml").write_text("")
    for size in (1 << 20, 4000):
        small_splits(size)
        rows = element_pairs(spark, str(tmp_path)).collect()
        assert {(r.file_path.rsplit("/", 1)[1], r.parent, r.child): r.n for r in rows} == wanted
    found = {(r.file_path.rsplit("/", 1)[1], r.parent, r.child) for r in structure_of_any(spark, str(tmp_path)).collect()}
    assert found == {k for k in wanted if k[1] is not None}


def test_deep_and_broken_files(spark, small_splits, tmp_path):
    (tmp_path / "deep.xml").write_text("<x>" * 3000 + "</x>" * 3000)
    (tmp_path / "broken.xml").write_text("</b></c><a><b></b></a></a></a><d/>")
    small_splits(2000)
    rows = {(r.file_path.rsplit("/", 1)[1], r.parent, r.child): r.n for r in element_pairs(spark, str(tmp_path)).collect()}
    assert rows == {("deep.xml", None, "x"): 1, ("deep.xml", "x", "x"): 2999, ("broken.xml", None, "a"): 1, ("broken.xml", "a", "b"): 1, ("broken.xml", None, "d"): 1}


def nested(draw, depth=0):
    inside = "".join(nested(draw, depth + 1) if draw.random() < 0.5 and depth < 4 else draw.choice(["<x>1</x>", "text", "<mm/>", "<m/>"]) for _ in range(draw.randint(0, 4)))
    return f"<m{draw.choice(['', ' k="1"'])}>{inside}</m{draw.choice(['', ' '])}>"


def test_records_inside_records(spark, small_splits, tmp_path):
    wanted, closed = [], 0
    for seed in range(4):
        draw = random.Random(seed)
        text = f"<all>{' '.join(nested(draw) for _ in range(30))}</all>\n"
        (tmp_path / f"{seed}.xml").write_text(text)
        wanted += list(ET.fromstring(text).iter("m"))
        closed += text.count("<m/>")
    # self-closing elements have no closing tag and are no records
    shapes = Counter(len(list(e.iter())) for e in wanted) - Counter({1: closed})
    for size in (1 << 20, 300):
        small_splits(size)
        records = [r.record for r in scan_nested_records(spark, str(tmp_path), "m").collect()]
        assert Counter(len(list(ET.fromstring(r).iter())) for r in records) == shapes
