"""The catalogue of event types and the fixed rules that hang on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the trace format, in order of id: name, first version, whether a stack id follows, names of the
# arguments, names of the string arguments.
_TYPES = """
None 1005 - - -
Batch 1005 - p,ticks -
Frequency 1005 - freq -
Stack 1005 - id,siz -
Gomaxprocs 1005 S procs -
ProcStart 1005 - thread -
ProcStop 1005 - - -
GcStart 1005 S seq -
GcDone 1005 - - -
GcStwStart 1005 - kindid kind
GcStwDone 1005 - - -
GcSweepStart 1005 S - -
GcSweepDone 1005 - swept,reclaimed -
GoCreate 1005 S g,stack -
GoStart 1005 - g,seq -
GoEnd 1005 - - -
GoStop 1005 S - -
GoSched 1005 S - -
GoPreempt 1005 S - -
GoSleep 1005 S - -
GoBlock 1005 S - -
GoUnblock 1005 S g,seq -
GoBlockSend 1005 S - -
GoBlockRecv 1005 S - -
GoBlockSelect 1005 S - -
GoBlockSync 1005 S - -
GoBlockCond 1005 S - -
GoBlockNet 1005 S - -
GoSysCall 1005 S - -
GoSysExit 1005 - g,seq,ts -
GoSysBlock 1005 - - -
GoWaiting 1005 - g -
GoInSyscall 1005 - g -
HeapAlloc 1005 - mem -
NextGc 1005 - mem -
TimerGoroutine 1005 - g -
FutileWakeup 1005 - - -
String 1007 - - -
GoStartLocal 1007 - g -
GoUnblockLocal 1007 S g -
GoSysExitLocal 1007 - g,ts -
GoStartLabel 1008 - g,seq,labelid label
GoBlockGc 1008 S - -
GcMarkAssistStart 1009 S - -
GcMarkAssistDone 1009 - - -
UserTaskCreate 1011 S taskid,pid,typeid name
UserTaskEnd 1011 S taskid -
UserRegion 1011 S taskid,mode,typeid name
UserLog 1011 S id,keyid category,message
"""


def _parse():
    rows = []
    for i, line in enumerate(_TYPES.split("\n")[1:-1]):
        name, version, stack, args, strings = line.split()
        split = lambda s: [] if s == "-" else s.split(",")
        rows.append((i, name, int(version), stack == "S", split(args), split(strings)))
    return rows


TYPES = _parse()
ID = {name: i for i, name, *_ in TYPES}
NAME = {i: name for i, name, *_ in TYPES}
VERSIONS = (1005, 1007, 1008, 1009, 1010, 1011)

#: Groups of event types by what they do to their goroutine.
STARTS = [ID[x] for x in ("GoStart", "GoStartLabel")]
SYNC_BLOCKS = [ID[x] for x in ("GoBlockSend", "GoBlockRecv", "GoBlockSelect", "GoBlockSync", "GoBlockCond")]
YIELDS = [ID["GoSched"], ID["GoPreempt"]]
ENDS = [ID["GoEnd"], ID["GoStop"]]
SILENT_BLOCKS = [ID["GoSleep"], ID["GoBlock"], ID["GoBlockGc"]]
STOPS = sorted([*ENDS, *YIELDS, *SILENT_BLOCKS, *SYNC_BLOCKS, ID["GoBlockNet"], ID["GoSysBlock"]])
#: Pseudo-processors.
TIMER_P, NETPOLL_P, SYSCALL_P, GC_P = 1000001, 1000002, 1000003, 1000004


def event_types(spark: SparkSession) -> DataFrame:
    """The catalogue as a table: ``type_id, type, min_version, has_stack, args, string_args``."""
    return spark.createDataFrame(TYPES, "type_id int, type string, min_version int, has_stack boolean, args array<string>, string_args array<string>")


def arity(type_id: int, version: int) -> int | None:
    """How many arguments a record of this type has in a trace of this version; None for stacks, which have any number."""
    name, stack, n = NAME[type_id], TYPES[type_id][3], len(TYPES[type_id][4])
    old = version < 1007
    if name == "Stack":
        return None
    n += stack
    if name in ("Batch", "Frequency", "TimerGoroutine"):
        return n + old
    n += 1 + old
    if name == "GcSweepDone" and version < 1009:
        n -= 2
    if name in ("GcStart", "GoStart", "GoUnblock") and old:
        n -= 1
    if name == "GcStwStart" and version < 1010:
        n -= 1
    return n
