"""Twenty invented raw lines in four batches of five, on which every built-in rule fires."""

SAMPLE = [
    ("WinEventLog:Security", "tower.example.net", [
        "2031-05-02T08:00:01Z EventCode=4625 sign-in of mira failed on console 3",
        "2031-05-02T08:00:05Z EventCode=4625 sign-in of mira failed on console 3",
        "2031-05-02T08:00:09Z EventCode=4625 sign-in of olaf failed on console 4",
        "2031-05-02T08:01:00Z EventCode=4624 sign-in of mira done",
        "2031-05-02T08:02:30Z EventCode=4688 parent=shellhost child=powershell -File nightly.ps1",
    ]),
    ("pan:traffic", "gate-7", [
        "2031-05-02T08:00:05Z FLOW,pass,172.20.4.9,172.20.9.1,41000,8443,udp,bytes=77",
        "2031-05-02T08:00:06Z FLOW,deny,172.20.4.9,198.51.100.7,41001,443,tcp,rule=block-malicious",
        "2031-05-02T08:00:07Z FLOW,pass,172.20.4.12,203.0.113.80,41002,53,udp,bytes=310",
        "2031-05-02T08:00:08Z SCAN,note,172.20.4.30,tile.evil-domain.test,0,80,tcp,threat_type=beacon,grade=high",
        "2031-05-02T08:00:09Z FLOW,deny,203.0.113.5,172.20.9.4,50222,22,tcp,rule=block-external-ssh",
    ]),
    ("linux_secure", "shop-2", [
        "May  2 08:00:01 shop-2 gatekeeper[88]: Failed password of guest via tty4",
        "May  2 08:00:05 shop-2 gatekeeper[88]: Failed password of guest via tty4",
        "May  2 08:00:20 shop-2 gatekeeper[91]: authentication failure; failed twice for olaf",
        "May  2 08:03:00 shop-2 gatekeeper[93]: Accepted publickey of release-bot",
        "May  2 08:04:11 shop-2 sudo: release-bot ; CWD=/srv ; RUN=/bin/rotate --now",
    ]),
    ("nginx:access", "shop-2", [
        '172.20.7.1 - - [02/May/2031:08:00:00 +0000] "GET /basket HTTP/2" 200 512 "-" "Firefox"',
        '172.20.7.2 - - [02/May/2031:08:00:05 +0000] "PUT /basket/9 HTTP/2" 204 0 "-" "curl/9.1"',
        '172.20.7.3 - - [02/May/2031:08:00:06 +0000] "GET /management/users HTTP/2" 401 17 "-" "python-requests/3"',
        '172.20.7.4 - - [02/May/2031:08:00:07 +0000] "GET /img/../secret HTTP/2" 404 0 "-" "sqlmap"',
        '172.20.7.5 - - [02/May/2031:08:00:08 +0000] "GET /terms HTTP/2" 200 2048 "-" "Firefox"',
    ]),
]
