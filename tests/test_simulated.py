"""Random traces of a simulated scheduler: windows against a sequential fold, and the whole way through a binary file."""

import random

from pyspark.sql import functions as F

from skein import api
from skein.functions.catalog import ID
from skein.operators import goroutines as G, linking
from traces import event as e, header, record, table

BLOCKS = {"GoBlockSend": "block", "GoBlockRecv": "block", "GoBlockSelect": "block", "GoBlockSync": "block", "GoBlockCond": "block", "GoBlockNet": "io", "GoSleep": None, "GoBlock": None, "GoBlockGc": None}


def simulate(seed, steps=120, procs=3):
    rng, t, n = random.Random(seed), 0, 0
    events, state, at, seq = [], {}, {}, {}
    for p in range(procs):
        events.append(e(p, "ProcStart", p=p))
    t = procs
    for _ in range(steps):
        t += rng.randint(1, 9)
        free = [p for p in range(procs) if p not in at]
        running = sorted(at.items())
        runnable = [g for g, s in state.items() if s == "runnable"]
        waiting = [g for g, s in state.items() if s == "waiting"]
        calls = [g for g, s in state.items() if s == "syscall"]
        what = rng.random()
        if (what < 0.15 or not state) and (running or free):
            p, g = rng.choice(running) if running else (free[0], 0)
            n += 1
            state[n], seq[n] = "runnable", 1
            events.append(e(t, "GoCreate", g=g, p=p, a=(n, 1)))
        elif what < 0.45 and runnable and free:
            g, p = rng.choice(runnable), rng.choice(free)
            state[g], at[p] = "running", g
            events.append(e(t, "GoStart", g=g, p=p, a=(g, seq[g])))
            seq[g] += 1
        elif what < 0.65 and waiting and (running or free):
            p, by = rng.choice(running) if running else (free[0], 0)
            g = rng.choice(waiting)
            state[g] = "runnable"
            events.append(e(t, "GoUnblock", g=by, p=p, a=(g, seq[g])))
            seq[g] += 1
        elif what < 0.72 and calls:
            g = rng.choice(calls)
            state[g] = "runnable"
            events.append(e(t, "GoSysExit", g=g, p=rng.choice(free or [0]), a=(g, seq[g])))
            seq[g] += 1
        elif running:
            p, g = rng.choice(running)
            kind = rng.choice([*BLOCKS, "GoSched", "GoPreempt", "GoSysCall", "GoEnd"])
            if kind == "GoSysCall":
                events.append(e(t, "GoSysCall", g=g, p=p))
                t += 1
                kind = "GoSysBlock"
            events.append(e(t, kind, g=g, p=p))
            state[g] = {"GoSched": "runnable", "GoPreempt": "runnable", "GoSysBlock": "syscall", "GoEnd": "dead"}.get(kind, "waiting")
            del at[p]
    return events


def fold(events):
    last = max(x["ts"] for x in events)
    open_, out = {}, {}
    for x in events:
        name, t = x["name"], x["ts"]
        g = x["a"][0] if name in ("GoCreate", "GoUnblock") else x["g"]
        if name in ("ProcStart", "GoSysCall"):
            continue
        if name == "GoCreate":
            out[g] = {"exec": 0, "sched_wait": 0, "io": 0, "block": 0, "syscall": 0, "born": t, "end": None}
        state, since = open_.pop(g, (None, 0))
        if state:
            out[g][state] += t - since
        now = "exec" if name == "GoStart" else "sched_wait" if name in ("GoCreate", "GoSched", "GoPreempt", "GoUnblock", "GoSysExit") else "syscall" if name == "GoSysBlock" else BLOCKS.get(name)
        if name == "GoEnd":
            out[g]["end"] = t
        elif now:
            open_[g] = (now, t)
    for g, (state, since) in open_.items():
        out[g][state] += last - since
    return {g: (*(r[s] for s in G.STATES), (r["end"] if r["end"] is not None else last) - r["born"]) for g, r in out.items()}


def test_times_of_simulated_traces(spark):
    traces = [simulate(seed) for seed in range(40)]
    ev = table(spark, *traces).cache()
    got = {}
    for r in G.goroutines(ev).collect():
        got.setdefault(r.trace_id, {})[r.g] = (*(r[f"{s}_time"] for s in G.STATES), r.total_time)
    assert got == {f"t{i}": want for i, t in enumerate(traces) if (want := fold(t))}
    assert linking.state_violations(ev).count() == 0
    assert linking.processor_violations(ev.where(F.col("type_id") != ID["GoSysExit"])).count() == 0
    spent = G.state_intervals(ev).where("state is null and type_id not in (15, 16) and end_ts is not null").agg(F.sum(F.col("end_ts") - F.col("ts"))).first()[0]
    assert spent > 0  # sleeps and the like belong to no counter, so the sums stay within the totals
    for by in got.values():
        assert all(sum(v[:5]) <= v[5] for v in by.values())


def test_simulated_trace_through_a_file(spark, tmp_path):
    for n, seed in enumerate((101, 102, 103)):
        events, parts = simulate(seed), [header("1.11")]
        for p in range(3):
            own, base = [x for x in events if x["p"] == p], 5
            parts.append(record("Batch", p, base))
            for x in own:
                a = list(x["a"]) if x["name"] != "ProcStart" else [1]
                if x["name"] == "GoSysExit":
                    a += [0]  # no real time
                args = [x["ts"] + 5 - base, *a]
                if x["name"] not in ("ProcStart", "GoStart", "GoEnd", "GoSysBlock", "GoSysExit"):
                    args.append(0)  # a stack
                parts.append(record(x["name"], *args))
                base = x["ts"] + 5
        parts.append(record("Frequency", 10**9))
        (tmp_path / f"s{n}.trace").write_bytes(b"".join(parts))
    t = api.read_trace(spark, str(tmp_path))
    got = {}
    for r in t.events.orderBy("trace_id", "ord").collect():
        got.setdefault(r.trace_id, []).append((r.ts, r.type, r.a0 if r.type in ("GoCreate", "GoUnblock", "GoStart", "GoSysExit") else r.g))
    for n, seed in enumerate((101, 102, 103)):
        assert got[f"s{n}"] == [(x["ts"], x["name"], x["a"][0] if x["name"] in ("GoCreate", "GoUnblock", "GoStart", "GoSysExit") else x["g"]) for x in simulate(seed)]
    assert t.violations.where("rule_id = 'state'").count() == 0
