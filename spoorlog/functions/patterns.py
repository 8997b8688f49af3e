"""Line patterns, word lists, error and finding texts.

These must equal the formats being recognised, so they are stated as they are.
Patterns are written with ``\\s``, ``\\S`` and ``.``; :func:`java` rewrites those
three to what the formats mean by them (Unicode blanks, line ends).
"""

from __future__ import annotations

import re

# ---- fixed values -----------------------------------------------------------
BLANKS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

RFC5424 = r"^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\[.+?\]|-)(?:\s+(.*))?$"
RFC5424_SNIFF = r"^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)(?:\s+(.*))?$"
BSD = r"^(?:<(\d+)>)?([A-Za-z]{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\[:]+)(?:\[(\d+)\])?:\s*(.*)$"
ACCESS = r'^(\S+) (\S+) (\S+) \[(.*?)\] "(.*?)" (\d{3}) (\S+)(?: "([^"]*)" "([^"]*)")?$'
KEY_VALUE = r"""([a-zA-Z0-9_\-\.]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S+))"""
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
USER = r"""(?i)(?:for invalid user|for user|for|user=|username=)\s*["']?([a-zA-Z0-9_\-\.]+)"""
PATH = r"(?:^|\s)(\/[a-zA-Z0-9_\-\.\/]+)"
EXIT_STATUS = r"(?i)(?:status|exit|code)=(\d+)"
ACCESS_DATE = r"^(\d{2})\/([A-Za-z]{3})\/(\d{4}):(\d{2}):(\d{2}):(\d{2})\s+([+-]\d{4})$"
PORT_DST = r"(?:DST|dst)=(\d+)"
PORT_NAMED = r"(?:port|Port|PORT|dport|dest_port)[=:\s]+(\d+)"
PORT_SOCKET = r":(\d+)\b"

TS_KEYS = ["timestamp", "time", "ts", "date", "datetime", "eventtime"]
IP_KEYS = ["ip", "ip_address", "client_ip", "sourceipaddress", "src", "src_ip", "client"]
USER_KEYS = ["username", "user", "user_name", "email", "usr"]
ACTION_KEYS = ["action", "event", "method", "event_name", "eventname", "msg", "message", "info"]
RESOURCE_KEYS = ["resource", "path", "url", "uri", "file", "target", "eventsource"]
STATUS_KEYS = ["status", "statuscode", "status_code", "code"]

FAILURE_WORDS = ["failed", "failure", "error", "kill", "out of memory", "oom"]
SUCCESS_WORDS = ["accepted", "success"]
SSH_FAILURE_WORDS = ["failed password", "invalid user", "authentication failure"]
LOGIN_WORDS = ["accepted password", "accepted publickey", "session opened for user"]
PRIVILEGE_WORDS = ["sudo", "su -", "/etc/sudoers", "passwd", "usermod", "groupadd"]
SEVERITIES = ["critical", "high", "medium", "low", "info"]

SYSLOG_ERROR = "Line does not match RFC 5424 or RFC 3164 syslog formats"
ACCESS_ERROR = "Line does not match Apache/Nginx combined log format"
AUDIT_ERROR = "Parsed JSON does not appear to be an AWS CloudTrail event (missing key fields)"
JSON_ERROR = "Invalid JSON"
NO_CONTEXT = "No relevant log entries found for this session."
DEFAULT_RECOMMENDATION = "Review system logs configurations."
UNKNOWN_ASSET = "Unknown/Internal"

SSH_TITLE = "SSH Brute Force Attack Detected from {ip}"
SSH_TEXT = "IP {ip} performed {n} failed SSH login attempts within a {window} sliding window."
WEB_TITLE = "Web Brute Force Attack Detected from {ip}"
WEB_TEXT = "IP {ip} generated {n} unauthorized HTTP responses (401/403) within a {window} sliding window."
SCAN_TITLE = "Port Scan Activity Detected from {ip}"
SCAN_TEXT = "IP {ip} scanned {n} distinct destination ports within a {window} time window."
PRIVILEGE_TITLE = "Potential Privilege Escalation: {user} executing {pattern}"
PRIVILEGE_TEXT = 'User "{user}" executed a command matching privilege escalation signature: "{pattern}".'
LOGIN_TITLE = "Off-Hours User Access: {user}"
LOGIN_TEXT = 'Successful user login detected during off-hours (23:00 - 05:00 UTC) for user "{user}".'
# ---- end of fixed values ----------------------------------------------------

# The plain ASCII test comes first, so that it settles nearly every character.
_ASCII = r"\x21-\x7e"
_BLANK = r"\x09-\x0d\x20\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_WORD = "A-Za-z0-9_"


def java(pattern: str) -> str:
    """The pattern in Java's dialect, independent of its Unicode defaults."""
    pattern = pattern.replace(r"[=:\s]", f"[=:{_BLANK}]")
    pattern = pattern.replace(r"\S", f"[{_ASCII}[^{_BLANK}]]")
    pattern = pattern.replace(r"\s", f"[[^{_ASCII}]&&[{_BLANK}]]")
    pattern = re.sub(r"(?<!\\)\.(?=[*+])", r"[^\\n\\r\\u2028\\u2029]", pattern)
    if pattern.startswith(r"\b"):
        pattern = f"(?<![{_WORD}])" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + f"(?![{_WORD}])"
    return re.sub(r"\$$", r"\\z", pattern)
