"""Keys on neighbouring, indented and wrapped lines."""

import base64

from scorelens.llm.secret_scan import find_secrets, redacted


def der(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else b"\x81" + bytes([len(body)]) if len(body) < 256 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


ED25519 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, der(4, bytes(range(32)))))
RSA = der(0x30, der(2, b"\0") + b"".join(der(2, b"\x01" + bytes(range(1, 60))) for _ in range(8)))
PUBLIC = der(0x30, der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + der(5, b"")) + der(3, b"\0" * 271))


def coded(data):
    return base64.b64encode(data).decode()


def spans(text, *keys):
    return [("der", text.index(k), text.index(k) + len(k)) for k in keys]


def test_keys_on_adjacent_lines():
    one, two = coded(ED25519), coded(ED25519[:-1] + b"\xff")
    assert len(ED25519) == 48 and "=" not in one
    for gap in ("\n", "\r\n", "\\n", "\n    "):
        text = f"{one}{gap}{two}{gap}end of it"
        assert find_secrets(text) == spans(text, one, two), repr(gap)
        assert one not in redacted(text) and two not in redacted(text)


def test_public_key_or_long_word_above_a_private_key():
    public, key = coded(PUBLIC), coded(RSA)
    assert len(PUBLIC) % 3 == 0 and "=" not in public
    for above in (public, "see MAINTENANCEWINDOWSCHEDULE"):
        text = f"{above}\n{key}\nend of it"
        assert find_secrets(text) == spans(text, key)


def test_indented_pem_and_wrapped_hex():
    key = coded(RSA)
    lines = "\n      ".join(key[k:k + 64] for k in range(0, len(key), 64))
    text = f"key: |\n      {lines}\n      -----END\n"
    assert find_secrets(text) == spans(text, lines)
    dump = RSA.hex().upper()
    lines = " \n\t".join(dump[k:k + 30] for k in range(0, len(dump), 30))
    assert find_secrets(f"x {lines}\nend") == [("der", 2, 2 + len(lines))]
    assert ("der", 0, len(dump)) in find_secrets(dump)
    assert [x for x in find_secrets(dump[:60] + "\n" + dump[:-2]) if x[0] == "der"] == []


def test_coded_characters_are_decoded_a_few_times_at_most(monkeypatch):
    """Lines that each look like the start of a key, a PEM or an OpenSSH text, in one long chain: nothing is gathered again and again."""
    import scorelens.llm.secret_scan as module
    count = [0]
    plain = base64.b64decode

    def counted(chars, *more):
        count[0] += len(chars)
        return plain(chars, *more)
    monkeypatch.setattr(module.base64, "b64decode", counted)
    heads = [coded(b"\x30\x82\x30\x00\x02\x01\x00\x30" + bytes(40)), coded(b"-----BEGIN CERTIFICATE-----\nMII" + b"A" * 18), coded(b"openssh-key-v1\0" + b"\0" * 33)]
    for k, head in enumerate([*heads, None]):
        lines = [(head or heads[j % 3])[:64 - (j % 4)] for j in range(3000)]
        text = "\n".join(lines)
        count[0] = 0
        assert find_secrets(text) == []
        assert count[0] <= 5 * len(text) + 4 * len(text) * 3, k  # four alignments, and what certificates decode to once more
    hidden = "\n".join(["M" + "I" * 63] * 500 + [coded(RSA)] + ["M" + "I" * 63] * 500)
    assert spans(hidden, coded(RSA))[0] in find_secrets(hidden)


def test_pem_coded_once_more():
    pem = "-----BEGIN PRIVATE KEY-----\n" + coded(RSA) + "\n-----END PRIVATE KEY-----\n"
    twice = coded(pem.encode())
    lines = "\n".join(twice[k:k + 76] for k in range(0, len(twice), 76))
    for text in (twice, lines, f"x: {lines}\nend here"):
        got = find_secrets(text)
        assert [k for k, _, _ in got] == ["der"] and got[0][1] == text.index(twice[:20])
    public = coded(f"-----BEGIN PUBLIC KEY-----\n{coded(PUBLIC)}\n-----END".encode())
    assert find_secrets(public) == []
