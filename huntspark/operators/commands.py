"""What a command does, told from its segments and words.

``judged`` cuts the commands once (``functions.shell``); every question is then
a column over the segments, so a rule sees operands instead of text: a path that
is copied from is no path that is written to.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.common import any_of, first_match, let
from ..functions.shell import SHELLS, command_parts

# Programs by what they do with their operands.
DOWNLOADERS = ("curl", "wget", "fetch")
OUTPUT_OPTIONS = {"curl": ("-o", "--output"), "wget": ("-O", "--output-document", "-o"), "fetch": ("-O", "--output-document", "-o")}
INTERPRETERS = ("python", "python3", "php", "perl")
ACCOUNT_TOOLS = ("useradd", "adduser", "chpasswd")
READERS = ("ls", "cat", "grep", "egrep", "fgrep", "head", "tail", "stat", "find", "test", "[", "sha256sum", "diff", "echo", "printf")
COPIERS = ("cp", "install")
FIND_ACTIONS = ("-exec", "-execdir", "-delete", "-ok", "-okdir")
WRITE_ARROWS = (">", ">>", "&>", "&>>")
LISTING_OPTIONS = ("-l", "--list", "--help", "-h")
# Places where something is made to start by itself, and folders of the staging rule.
START_FILES = ("profile", ".profile", "bashrc", ".bashrc", "rc.local")
SERVED_FOLDERS = ("/home", "/var/www")
PARKING_FOLDERS = ("/tmp", "/dev/shm")

#: Words without which no rule here can apply; other commands need not be cut.
CANDIDATE = r"(?i)\b(curl|wget|fetch|crontab|cron|systemctl|useradd|adduser|chpasswd|scp|sftp|tar)\b|cron\.|authorized_keys|systemd|profile|bashrc|rc\.local|sftp-server"


def persistent_place(word: Column) -> Column:
    """The word names a file or folder from which something starts by itself."""
    names = F.split(F.lower(word), "/")
    last = F.element_at(names, -1)
    cron = F.exists(names, lambda n: n.isin("cron", "crontab") | n.startswith("cron."))
    units = F.concat(F.lower(word), F.lit("/")).contains("/etc/systemd/system/")
    return F.lower(word).contains("authorized_keys") | cron | units | last.isin(*START_FILES)


def program(argv: Column) -> Column:
    """Base name of the program, behind ``sudo``."""
    return F.element_at(F.split(F.coalesce(F.get(_own(argv), F.lit(0)), F.lit("")), "/"), -1)


def _own(argv: Column) -> Column:
    return F.when(F.get(argv, F.lit(0)) == "sudo", F.slice(argv, 2, F.size(argv))).otherwise(argv)


def _rest(argv: Column) -> Column:
    return F.slice(argv, 2, F.greatest(F.size(argv), F.lit(1)))


def _after(argv: Column, words) -> Column:
    """Words that stand directly behind one of ``words``."""
    return F.filter(argv, lambda w, i: (i > 0) & F.get(argv, i - 1).isin(*words))


def _has(argv: Column, *words: str) -> Column:
    return F.arrays_overlap(argv, F.array(*[F.lit(w) for w in words]))


def _copy_target(argv: Column) -> Column:
    """Where a copy goes: the folder option in either spelling, else the last operand."""
    option = F.get(_after(argv, ("-t", "--target-directory")), F.lit(0))
    long = F.get(F.filter(argv, lambda w: w.startswith("--target-directory=")), F.lit(0))
    return F.coalesce(option, F.substring_index(long, "=", -1), F.element_at(argv, -1))


def writes_persistence(segment_argv: Column) -> Column:
    """The segment changes what starts by itself; reading, listing and backing it up does not count.

    Tools that are not known to read keep the suspicion, as do substitutions,
    which can write inside a command that reads.
    """

    def decide(argv):
        name, rest = program(argv), _rest(argv)
        touched = F.exists(rest, persistent_place)
        packs = F.exists(rest, lambda w: w.isin("--create", "--list") | (w.rlike("^-[^-]*[ct]")))
        return first_match(
            (F.exists(_after(argv, WRITE_ARROWS), persistent_place), True),
            (name.isin(*ACCOUNT_TOOLS), True),
            (name == "systemctl", _has(rest, "enable")),
            (name == "crontab", ~_has(rest, *LISTING_OPTIONS)),
            (~touched, False),
            (F.exists(argv, lambda w: w.contains("$(") | w.contains("`")), True),
            (name == "find", _has(argv, *FIND_ACTIONS)),
            (name == "tar", ~packs),
            (name.isin(*READERS), False),
            (name.isin(*COPIERS), persistent_place(_copy_target(argv))),
            (name == "sed", F.exists(rest, lambda w: w.startswith("-i") | w.startswith("--in-place"))),
            default=True)

    return (F.size(segment_argv) > 0) & let(_own(segment_argv), decide)


def command_writes_persistence(command: Column) -> Column:
    """One of the command's segments changes what starts by itself."""
    segments = command_parts(F.when(command.rlike(CANDIDATE), command))["segments"]
    return F.coalesce(F.exists(segments, lambda s: writes_persistence(s["argv"])), F.lit(False))


def _runner(word: Column) -> Column:
    """The word is a shell or a script interpreter, by its base name; versions of python count."""
    base = F.element_at(F.split(word, "/"), -1)
    return base.isin(*SHELLS, *INTERPRETERS) | base.rlike(r"^python[0-9.]+$")


def _pipes_download(plain: Column) -> Column:
    """In one statement a download stands before a pipe into something that runs it, or inside what a runner is given."""

    def first_word(part):
        words = F.split(F.ltrim(part), r"\s+")
        return F.when(F.get(words, F.lit(0)) == "sudo", F.get(words, F.lit(1))).otherwise(F.get(words, F.lit(0)))

    def downloads(part):
        return F.exists(F.split(part, r"[^\w]+"), lambda w: w.isin(*DOWNLOADERS))

    def statement(text):
        pieces = F.split(text, r"\|")
        runs = lambda ps, i: _runner(F.regexp_extract(F.coalesce(first_word(F.get(ps, i)), F.lit("")), r"^([\w./-]*)", 1))
        return let(pieces, lambda ps: F.exists(F.sequence(F.lit(1), F.size(ps)), lambda i: runs(ps, i) & F.exists(F.slice(ps, 1, i), downloads)))

    def substituted(text):
        # What follows a process or command substitution, and the word or two before it.
        heads = F.split(text, r"[<$]\(\s*(?=(?:" + "|".join(DOWNLOADERS) + r")\b)")

        def given(head):
            words = F.filter(F.split(F.trim(head), r"\s+"), lambda w: w != "")
            last = F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2))
            return (F.size(words) > 0) & F.exists(last, _runner)

        return F.exists(F.slice(heads, 1, F.greatest(F.size(heads) - 1, F.lit(0))), given)

    return F.exists(F.split(plain, ";"), statement) | substituted(plain)


def _saved_to(argv: Column) -> Column:
    """Files that a download is written to."""
    name = program(argv)
    tool = first_match(*[(name == n, F.array(*[F.lit(o) for o in options])) for n, options in OUTPUT_OPTIONS.items()], default=F.array().cast("array<string>"))
    behind = F.filter(argv, lambda w, i: (i > 0) & F.array_contains(tool, F.get(argv, i - 1)))
    long = F.filter(argv, lambda w: w.startswith("--") & w.contains("=") & F.array_contains(tool, F.substring_index(w, "=", 1)))
    return F.concat(behind, F.transform(long, lambda w: F.substring(w, F.instr(w, "=") + 1, F.length(w))))


def runs_download(plain: Column, segments: Column) -> Column:
    """A download is piped into a runner, given to one, or saved and run by a later segment."""
    start = F.struct(F.array().cast("array<string>").alias("saved"), F.lit(False).alias("run"))

    def step(state, segment):
        argv, name = segment["argv"], program(segment["argv"])
        ran = F.array_contains(state["saved"], F.coalesce(F.get(argv, F.lit(0)), F.lit(""))) | (_runner(name) & F.arrays_overlap(_rest(argv), state["saved"]))
        loads = name.isin(*DOWNLOADERS)
        return F.struct(F.when(loads, F.concat(state["saved"], _saved_to(argv))).otherwise(state["saved"]).alias("saved"), (state["run"] | F.coalesce(~loads & ran, F.lit(False))).alias("run"))

    return F.coalesce(_pipes_download(plain), F.lit(False)) | F.aggregate(segments, start, step, lambda s: s["run"])


def only_receives(segments: Column) -> Column:
    """Every segment is the receiving end of a copy that another host started."""

    def receives(segment):
        argv, name = segment["argv"], F.element_at(F.split(F.coalesce(F.get(segment["argv"], F.lit(0)), F.lit("")), "/"), -1)
        return (name == "sftp-server") | ((name == "scp") & F.exists(_rest(argv), lambda w: w.rlike("^-[^-]*t")))

    return (F.size(segments) > 0) & F.forall(segments, receives)


def stages_data(segments: Column) -> Column:
    """An archive of served or home folders is parked where anyone may write, by its own operands or further down the line."""
    under = lambda w, folders: any_of(*[F.concat(w, F.lit("/")).contains(f + "/") for f in folders])

    def parks(i):
        return F.exists(F.slice(segments, i + 1, F.size(segments)), lambda s: F.exists(s["argv"], lambda w: under(w, PARKING_FOLDERS)))

    numbers = F.when(F.size(segments) > 0, F.sequence(F.lit(0), F.size(segments) - 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(numbers, lambda i: (program(F.get(segments, i)["argv"]) == "tar") & F.exists(_rest(F.get(segments, i)["argv"]), lambda w: under(w, SERVED_FOLDERS)) & parks(i))


def judged(df: DataFrame, column: str = "command", name: str = "__cmd") -> DataFrame:
    """Adds a struct of what the command does: ``writes_persistence, runs_download, only_receives, stages_data``.

    Commands without any of the words the rules look for are not cut at all.
    Arrays and their JSON keep their argument boundaries.
    """
    if column not in df.columns:
        return df.withColumn(name, F.struct(*[F.lit(False).alias(q) for q in QUESTIONS]))
    is_list = isinstance(df.schema[column].dataType, T.ArrayType)
    text = F.concat_ws(" ", F.col(column)) if is_list else F.col(column).cast("string")
    asked = F.when(text.rlike(CANDIDATE), F.col(column) if is_list else text)
    d = df.withColumn(name, command_parts(asked, is_list))
    segments, plain = F.col(f"{name}.segments"), F.col(f"{name}.plain")
    answers = {"writes_persistence": F.exists(segments, lambda s: writes_persistence(s["argv"])), "runs_download": runs_download(plain, segments),
               "only_receives": only_receives(segments), "stages_data": stages_data(segments)}
    # A generator of one row: the answers are settled here and not again wherever a rule or filter uses them.
    return d.withColumn(name, F.explode(F.array(F.struct(*[F.coalesce(answers[q], F.lit(False)).alias(q) for q in QUESTIONS]))))


QUESTIONS = ("writes_persistence", "runs_download", "only_receives", "stages_data")
