"""Filters and encryption of PDF streams."""

import base64
import hashlib
import random
import zlib

import pytest

from quire.sources import pdf
from quire.sources import pdf_streams as S
from quire.sources.structured import ParseFailed


def lzw_of(data, early=1):
    """An encoder of its own: codes in growing widths, cleared at the start and when the table is full."""
    out, bits, held, codes = bytearray(), 0, 0, []
    table, width = {bytes([k]): k for k in range(256)}, 9

    def put(code, width):
        nonlocal bits, held
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    size, own = 258, b""
    put(256, 9)
    for k in range(len(data)):
        if own + data[k : k + 1] in table:
            own += data[k : k + 1]
            continue
        put(table[own], width)
        codes.append(table[own])
        table[own + data[k : k + 1]] = size
        size += 1
        own = data[k : k + 1]
        width = min(12, max(9, (size - 1 + early).bit_length()))
        if size == 4096:
            put(table[own], width)
            put(256, width)
            table, size, own, width = {bytes([k]): k for k in range(256)}, 258, b"", 9
    if own:
        put(table[own], width)
        width = min(12, max(9, (size + early).bit_length()))
    put(257, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


@pytest.mark.parametrize("early", [1, 0])
def test_lzw(early):
    assert S.lzw(bytes.fromhex("800B6050220C0C8501")) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])  # the example of the PDF specification
    rng = random.Random(1)
    for n in (1, 50, 600, 30_000):
        data = bytes(rng.choice(b"abcd \n") for _ in range(n))
        assert S.lzw(lzw_of(data, early), early) == data
    with pytest.raises(S.StreamError):
        S.lzw(bytes([128, 63, 255, 255]))


def test_predictors():
    rows = [bytes([1, 2, 3, 4]), bytes([2, 4, 6, 8]), bytes([255, 0, 1, 9])]
    for kind in range(5):
        out, above = b"", bytes(4)
        for row in rows:
            guess = []
            for k in range(4):
                left, up, corner = (row[k - 1] if k else 0), above[k], (above[k - 1] if k else 0)
                p = left + up - corner
                paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
                guess.append((0, left, up, (left + up) // 2, paeth)[kind])
            out += bytes([kind]) + bytes((v - g) & 255 for v, g in zip(row, guess, strict=True))
            above = row
        assert S.predicted(out, 15, 4, 1, 8) == b"".join(rows)
    assert S.predicted(bytes([1, 1, 1, 1, 2, 2]), 2, 3, 1, 8) == bytes([1, 2, 3, 1, 3, 5])


def test_filters_in_a_row():
    text = b"BT (some text) Tj ET " * 20
    assert S.decoded(b"<< /Filter [/ASCII85Decode /FlateDecode] >>", base64.a85encode(zlib.compress(text)) + b"~>") == text
    assert S.decoded(b"<< /Filter /AHx >>", text.hex().encode() + b">") == text
    assert S.decoded(b"<< /F /LZW /DP << /EarlyChange 0 >> >>", lzw_of(text, 0)) == text
    assert S.decoded(b"<< /Filter /RunLengthDecode >>", bytes([2]) + b"abc" + bytes([254]) + b"x" + bytes([128])) == b"abcxxx"
    assert S.decoded(b"<< /Filter [/FlateDecode] /DecodeParms [<< /Predictor 12 /Columns 3 >>] /Length 9 >>", zlib.compress(b"\x02abc\x02\x01\x01\x01")) == b"abcbcd"
    assert S.decoded(b"<< /Filter /DCTDecode >>", b"image") == b"image"


def test_rc4():
    assert S.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def encrypted(revision, password=b""):
    """A file of a page whose stream and title are encrypted."""
    size, owner, permissions, file_id = (5 if revision == 2 else 16), bytes(range(32)), -44, b"0123456789abcdef"
    key = hashlib.md5((password + S.PADDING)[:32] + owner + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()
    for _ in range(50 if revision == 3 else 0):
        key = hashlib.md5(key[:size]).digest()
    key = key[:size]
    if revision == 2:
        user = S.rc4(key, S.PADDING)
    else:
        user = S.rc4(key, hashlib.md5(S.PADDING + file_id).digest())
        for k in range(1, 20):
            user = S.rc4(bytes(b ^ k for b in key), user)
        user += bytes(16)
    own = lambda number, data: S.rc4(S.object_key(key, number, 0), data)
    stream = own(4, zlib.compress(b"BT /F1 9 Tf (Hidden text) Tj ET"))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>",
        b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(stream) + stream + b"\nendstream", b"<< /Title <" + own(5, b"Secret title").hex().encode() + b"> >>",
        b"<< /Filter /Standard /V %d /R %d /Length %d /P %d /O <%s> /U <%s> >>" % (1 if revision == 2 else 2, revision, 8 * size, permissions, owner.hex().encode(), user.hex().encode()),
    ]
    body = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % n + o + b"\nendobj\n" for n, o in enumerate(objects, start=1))
    return body + b"trailer\n<< /Root 1 0 R /Info 5 0 R /Encrypt 6 0 R /ID [<" + file_id.hex().encode() + b"> <00>] >>\nstartxref\n0\n%%EOF"


@pytest.mark.parametrize("revision", [2, 3])
def test_files_that_open_without_a_password(revision):
    parts = pdf.pdf_parts(encrypted(revision), with_title=True)
    assert [(p[1], p[2]) for p in parts] == [("title", "Secret title"), ("paragraph", "Hidden text")]
    with pytest.raises(ParseFailed, match="PDF_ENCRYPTED"):
        pdf.pdf_parts(encrypted(revision, b"known"))
