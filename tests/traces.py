"""Small event tables and a binary encoder for tests."""

from skein.functions.catalog import ID, TYPES

SCHEMA = "trace_id string, rec_offset long, ord long, type_id int, raw_type_id int, version int, ts long, seq long, p int, g long, a0 long, a1 long, a2 long, string_args array<string>, stack_id long"


def event(ts, name, g=0, p=0, a=(), s=None, stack=0):
    return {"ts": ts, "name": name, "g": g, "p": p, "a": a, "s": s, "stack": stack}


def table(spark, *traces):
    """Each trace is a list of events in order."""
    rows = []
    for n, events in enumerate(traces):
        for i, e in enumerate(events):
            a = [*e["a"], 0, 0, 0][:3]
            rows.append((f"t{n}", 10 + i, i, ID[e["name"]], ID[e["name"]], 1011, e["ts"], None, e["p"], e["g"], *a, e["s"], e["stack"]))
    return spark.createDataFrame(rows, SCHEMA)


def varint(n):
    n &= (1 << 64) - 1
    out = bytearray()
    while True:
        out.append((n & 0x7F) | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            return bytes(out)


def text(s):
    data = s.encode()
    return varint(len(data)) + data


def record(name, *args, old=False, extra=b""):
    kind, n = ID[name], len(args)
    body = b"".join(map(varint, args))
    if n - 1 - old < 3:
        return bytes([kind | n - 1 - old << 6]) + body + extra
    return bytes([kind | 0xC0]) + varint(len(body)) + body + extra


def string(i, s):
    return bytes([ID["String"] | 0 << 6]) + varint(i) + text(s)


def header(version):
    return f"go {version} trace".encode().ljust(16, b"\0")


CATALOG = TYPES
