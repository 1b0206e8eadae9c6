"""Detection rules: a piped query and the condition under which it fires."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    description: str
    severity: str
    query: str
    condition: dict = field(default_factory=lambda: {"count_gt": 0})
    risk_score: int = 50
    techniques: tuple[str, ...] = ()
    earliest: str | None = None


def _r(id: str, severity: str, risk: int, search: str, name: str, description: str, techniques: tuple[str, ...], least: int = 0) -> Rule:
    """A rule that counts what ``search`` finds by host, hosts with fewer than ``least`` left out."""
    query = f"search index=main {search} | stats count by host" + (f" | where count >= {least}" if least else "")
    return Rule(id, name, description, severity, query, risk_score=risk, techniques=techniques)


# Ids, severities, risk scores, search words, techniques and thresholds of the built-in rules.
BUILTIN = (
    _r("BF-001", "high", 70, '(EventCode=4625 OR "Failed password" OR "failed login" OR "authentication failure")', "Many refused logins", "Three refused logins or more on one host.", ("T1110", "T1078"), least=3),
    _r("BF-002", "critical", 85, '(EventCode=4624 OR "Accepted publickey" OR "Accepted password")', "Login accepted", "Accepted logins, to be held against refused ones.", ("T1110", "T1078.001")),
    _r("PE-001", "medium", 55, 'EventCode=4688 ("cmd.exe" OR "powershell" OR "wscript" OR "cscript")', "Shell started", "A command interpreter or script host was started.", ("T1059.001", "T1059.003")),
    _r("PE-002", "medium", 45, "sudo", "Raised rights", "A command ran through sudo.", ("T1548.003",)),
    _r("FW-001", "critical", 90, "(THREAT OR threat_type) (critical OR high)", "Firewall threat", "The firewall reports a grave threat.", ("T1071", "T1571")),
    _r("FW-002", "low", 30, '("block-external-ssh" OR (deny port=22))', "Remote shell refused", "The firewall refused a remote shell from outside.", ("T1021.004",)),
    _r("WEB-001", "high", 65, '("../" OR "%2e%2e" OR "%2f")', "Path leaves the web root", "A requested path climbs out of the web root.", ("T1083", "T1190")),
    _r("WEB-002", "medium", 50, '("/admin" OR "/config" OR "/management") (403 OR 401)', "Refused management page", "A request for a management page was refused.", ("T1078", "T1190")),
    _r("NET-001", "critical", 95, '("evil-domain" OR spyware OR "block-malicious")', "Bad destination", "A host spoke to a destination known as bad.", ("T1071.001", "T1568")),
    _r("WEB-003", "medium", 55, '("Nikto" OR "sqlmap" OR "curl/" OR "python-requests")', "Scripted web client", "A scanner or scripted client asked for pages.", ("T1595.002",)),
)
