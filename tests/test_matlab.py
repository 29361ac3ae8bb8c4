"""MATLAB files written here byte by byte and read back."""

import struct
import zlib

import numpy as np
import pytest

from sigloom.sources import catalog as C
from sigloom.sources import matlab as L


def element(kind, data, order="<"):
    if 0 < len(data) <= 4:
        return struct.pack(f"{order}I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    return struct.pack(f"{order}II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(name, cls, dims, body, order="<"):
    head = element(6, struct.pack(f"{order}II", cls, 0), order) + element(5, struct.pack(f"{order}{len(dims)}i", *dims), order) + element(1, name.encode(), order)
    return element(14, head + body, order)


def numbers(name, x, order="<", kind=9, code="f8"):
    return matrix(name, 6, x.shape, element(kind, x.astype(np.dtype(code).newbyteorder(order)).tobytes("F"), order), order)


def text(t, order="<"):
    return matrix("", 4, (1, len(t)), element(4, np.array([ord(c) for c in t], np.dtype("u2").newbyteorder(order)).tobytes(), order), order)


def cells(name, items, order="<", deep=False):
    inner = [matrix("", 1, (1, 1), text(t, order), order) if deep else text(t, order) for t in items]
    return matrix(name, 1, (len(items), 1), b"".join(inner), order)


def file(parts, order="<", packed=False):
    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(f"{order}H", 0x0100) + (b"IM" if order == "<" else b"MI")
    pack = lambda p: struct.pack(f"{order}II", 15, len(z := zlib.compress(p))) + z
    return head + b"".join(map(pack, parts) if packed else parts)


@pytest.mark.parametrize(("order", "packed", "deep"), [("<", False, False), (">", False, True), ("<", True, True)])
def test_catalogue_round_trip(spark, tmp_path, monkeypatch, order, packed, deep):
    monkeypatch.setattr(L, "ROWS", 7)
    x = np.arange(12.0).reshape(4, 3)
    types, subtypes, samples = ["C>A", "C>G", "T>A", "T>C"], ["ACA", "ACG", "TTT", "GTC"], ["s1", "é2", "long name"]
    parts = [numbers("originalGenomes", x, order, 4, "u2"), cells("types", types, order, deep), cells("subtypes", subtypes, order, deep), cells("sampleNames", samples, order), matrix("cancerType", 4, (1, 3), element(16, b"BRC", order), order), matrix("s", 2, (1, 1), element(5, b"\0" * 8, order), order)]
    (tmp_path / "m.mat").write_bytes(file(parts, order, packed))
    got = {(r.channel, r.sample): r.cnt for r in C.read_input(spark, "matobj", str(tmp_path / "m.mat")).collect()}
    want = {(f"{s[0]}[{t}]{s[2]}", n): x[i, j] for i, (s, t) in enumerate(zip(subtypes, types, strict=True)) for j, n in enumerate(samples)}
    assert got == want
    other = {(r.name, r.text) for r in L.read_arrays(spark, str(tmp_path / "m.mat")).where("name = 'cancerType'").collect()}
    assert other == {("cancerType", "BRC")}


def test_bad_files():
    good = file([numbers("x", np.eye(9))])
    assert next(L.arrays(good))[1] == (9, 9)
    for bad in (b"", b"x" * 200, good[:-20], file([matrix("x", 6, (1, 1), element(14, b""))])):
        with pytest.raises(ValueError):
            list(L.arrays(bad))
