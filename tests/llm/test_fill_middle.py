import hashlib
import re

import pytest

from capforge.llm import fill_middle as M

SCHEMA = "doc_id long, text string, frames int, h1 int, `a.b` int"


def expected(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90
    form = "plain" if plain else "spm" if h4 % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, n, form, None if plain else len(p), None if plain else len(m), sha(out), sha(text), out)


TEXTS = ["", None, "a", "one two", "çava été — ok", "x<P>y", "<S", "<<M", "P><P", "\x00\x01 \n\r", "word" * 500, "日本語" * 70, "ab 9é" * 300, "<" * 50, "Z" * 1000]


@pytest.mark.parametrize("size", [4, 7, 64, 1 << 16])
def test_equals_the_definition(spark, size):
    rows = [(k * 100 + i, t) for k in range(4) for i, t in enumerate(TEXTS)] + [(None, "null id text"), (3, "one two"), (3, "one two")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in M.fill_in_middle(M.write_frames(docs, size=size), size=size, keep_output=True).collect()]
    assert sorted(got, key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_seek_table():
    text = ("abc déf " * 40 + "x" * 300 + " end").encode()
    f = M.Frames(32)
    for i in range(0, len(text), 5):
        f.write(text[i:i + 5])
    f.done()
    units = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text.decode())]
    assert f.units[-1] == len(units) and f.points[-1] == len(text.decode()) and b"".join(map(f.read, range(len(f.frames)))) == text
    for k, at in enumerate(units):
        i, byte, points = f.place(k)
        before = b"".join(map(f.read, range(i))) + f.read(i)[:byte]
        assert points == at and before.decode() == text.decode()[:at]
    assert f.place(len(units))[2] == len(text.decode())


def test_cut_frames_only(monkeypatch):
    f = M.Frames(64)
    f.write(b"some words here " * 1000)
    f.done()
    read = []
    monkeypatch.setattr(M.Frames, "read", lambda self, i, old=M.Frames.read: read.append(i) or old(self, i))
    f.place(2500)
    assert len(set(read)) <= 2 and len(f.frames) > 200


def test_empty_table(spark):
    assert M.fill_in_middle(M.write_frames(spark.createDataFrame([], SCHEMA))).count() == 0
