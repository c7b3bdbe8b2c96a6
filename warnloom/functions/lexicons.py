"""Fixed vocabularies: the keyword sets, names and action texts every report is matched against.

All keyword tests are case-insensitive substring tests, so entries are lower case. Order carries
meaning (ties go to the entry declared first) and is therefore part of the values.
"""

from __future__ import annotations

# Threat types and their trigger keywords, in declared order.
THREAT_KEYWORDS: dict[str, list[str]] = {
    "Ransomware": [
        "ransomware", "ransom note", "encrypted", "decryptor", "double extortion",
        "data encrypted for impact",
    ],
    "Phishing": [
        "phishing", "spearphishing", "malicious email", "lure", "spoofed", "credential harvesting",
    ],
    "Trojan / Malware": [
        "trojan", "malware", "backdoor", "remote access trojan", "rootkit", "dropper", "loader",
    ],
    "Vulnerability Exploitation": [
        "cve-", "exploit", "zero-day", "zero day", "unpatched", "vulnerability",
    ],
    "Data Breach / Exfiltration": [
        "data breach", "exfiltrat", "leaked", "stole data", "data theft",
    ],
    "DDoS": ["ddos", "denial of service", "botnet", "traffic flood"],
    "Credential Attack": [
        "credential", "brute force", "password spray", "mimikatz", "lsass", "dumping",
    ],
    "APT / Targeted Intrusion": [
        "apt", "advanced persistent", "espionage", "nation-state", "lateral movement",
    ],
}
UNKNOWN_THREAT = "Unknown / Other"

# Severity levels from weakest to strongest, and the keyword tier of each raised level.
SEVERITY_LEVELS = ["Low", "Medium", "High", "Critical"]
SEVERITY_KEYWORDS: dict[str, list[str]] = {
    "Critical": [
        "ransomware", "zero-day", "zero day", "actively exploited", "data encrypted", "widespread",
        "critical infrastructure", "double extortion",
    ],
    "High": [
        "exploit", "cve-", "backdoor", "data breach", "exfiltrat", "privilege escalation",
        "remote code execution",
    ],
    "Medium": [
        "phishing", "malware", "trojan", "suspicious", "vulnerability", "brute force",
    ],
}

# ATT&CK techniques as (id, name, tactic, keywords), in declared order.
TECHNIQUES: list[tuple[str, str, str, list[str]]] = [
    ("T1566", "Phishing", "Initial Access",
     ["phishing", "spearphishing", "spear phishing", "malicious email", "email attachment",
      "lure document"]),
    ("T1190", "Exploit Public-Facing Application", "Initial Access",
     ["exploit", "exploited", "vulnerability", "cve-", "zero-day", "zero day", "unpatched"]),
    ("T1133", "External Remote Services", "Initial Access",
     ["rdp", "remote desktop", "vpn", "exposed service", "brute force", "credential stuffing"]),
    ("T1078", "Valid Accounts", "Persistence",
     ["compromised credentials", "stolen credentials", "valid account", "credential theft",
      "password spray"]),
    ("T1059", "Command and Scripting Interpreter", "Execution",
     ["powershell", "cmd.exe", "wscript", "malicious script", "macro"]),
    ("T1003", "OS Credential Dumping", "Credential Access",
     ["credential dumping", "mimikatz", "lsass", "hash dumping", "dumped credentials"]),
    ("T1486", "Data Encrypted for Impact", "Impact",
     ["ransomware", "encrypted", "encryption", "ransom note", "decryptor", "double extortion"]),
    ("T1490", "Inhibit System Recovery", "Impact",
     ["deleted backups", "shadow copies", "vssadmin", "recovery disabled"]),
    ("T1041", "Exfiltration Over C2 Channel", "Exfiltration",
     ["exfiltrat", "data theft", "stole data", "leaked data"]),
    ("T1071", "Application Layer Protocol", "Command and Control",
     ["c2", "command and control", "c&c", "beacon", "callback", "malicious domain"]),
    ("T1021", "Remote Services", "Lateral Movement",
     ["lateral movement", "psexec", "wmi", "smb", "moved laterally"]),
    ("T1498", "Network Denial of Service", "Impact",
     ["ddos", "denial of service", "botnet", "traffic flood"]),
    ("T1204", "User Execution", "Execution",
     ["clicked", "opened the attachment", "enabled macros", "user executed",
      "social engineering"]),
    ("T1055", "Process Injection", "Defense Evasion",
     ["process injection", "hollowing", "injected into"]),
    ("T1110", "Brute Force", "Credential Access",
     ["brute force", "brute-force", "bruteforced"]),
]

# Terms that count towards sentence relevance beside every keyword above.
EXTRA_SUMMARY_TERMS = ["cve-", "ip ", "domain", "hash", "malware", "attack"]

# Malware families and threat actors.
MALWARE_NAMES = [
    "wannacry", "notpetya", "emotet", "trickbot", "ryuk", "conti", "lockbit", "maze", "revil",
    "sodinokibi", "blackcat", "alphv", "cobalt strike", "mimikatz", "qakbot", "dridex", "zeus",
    "stuxnet", "duqu", "flame", "apt28", "apt29", "lazarus", "cozy bear", "fancy bear",
]

# Affected products.
PRODUCT_NAMES = [
    "windows", "windows server", "linux", "macos", "android", "ios", "apache", "nginx",
    "microsoft exchange", "active directory", "vmware", "cisco", "fortinet", "palo alto",
]

# Recommended actions by threat type, and the one put first for Critical reports.
ACTIONS: dict[str, list[str]] = {
    "Ransomware": [
        "Isolate affected hosts from the network immediately",
        "Restore from clean offline backups; do not pay the ransom",
        "Block all identified C2 domains/IPs at the perimeter",
        "Hunt for lateral movement across the domain",
    ],
    "Phishing": [
        "Reset credentials for targeted users; enforce MFA",
        "Block sender domains and malicious URLs",
        "Run awareness refresher for affected teams",
    ],
    "Trojan / Malware": [
        "Quarantine infected endpoints",
        "Block file hashes at the email gateway and EDR",
        "Check for persistence mechanisms and scheduled tasks",
    ],
    "Vulnerability Exploitation": [
        "Patch affected software on priority",
        "Scan the estate for the listed CVEs",
        "Review logs for exploitation attempts",
    ],
    "Data Breach / Exfiltration": [
        "Engage incident response; preserve logs",
        "Identify scope of exfiltrated data",
        "Notify stakeholders per compliance requirements",
    ],
    "DDoS": [
        "Engage DDoS mitigation / scrubbing service",
        "Rate-limit and block attacking botnet IPs",
    ],
    "Credential Attack": [
        "Force password resets; enforce MFA everywhere",
        "Audit privileged account usage",
    ],
    "APT / Targeted Intrusion": [
        "Full incident-response engagement",
        "Threat-hunt across the estate for related IOCs",
    ],
    "Unknown / Other": [
        "Manually review the report",
        "Collect additional indicators before responding",
    ],
}
CRITICAL_ACTION = "Treat as an active incident: escalate to the SOC lead now"

# Indicator labels, in report order.
IOC_LABELS = ["cves", "ipv4", "urls", "emails", "md5", "sha1", "sha256", "domains"]

# Top-level domains that make a dotted name a domain, and the shorter list that marks
# an entity as a domain.
DOMAIN_TLDS = ["com", "net", "org", "io", "ru", "cn", "tk", "xyz", "top", "info", "biz", "online", "site", "club", "pw", "su", "ir", "in"]
ENTITY_NOISE_TLDS = ["com", "net", "org", "io", "ru", "cn", "tk", "xyz", "top", "info", "biz"]

# The English stop words that Spark ML's StopWordsRemover loads by default. Entries
# with an apostrophe never equal a term (terms hold word characters only) and are left out.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now cannot could ought would
""".split()


def all_keywords() -> list[str]:
    """Every distinct term any rule looks for, in a stable order."""
    groups = [
        *THREAT_KEYWORDS.values(),
        *SEVERITY_KEYWORDS.values(),
        *(keywords for _, _, _, keywords in TECHNIQUES),
        EXTRA_SUMMARY_TERMS,
    ]
    return list(dict.fromkeys(word for group in groups for word in group))
