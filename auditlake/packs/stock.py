"""The stock rule pack: detection rules and the control catalogues they point to.

Rules are rows; the catalogues are small dimension tables.  Their order is the order of output.
"""

from __future__ import annotations

# The vocabulary, contexts, severities, confidences and control ids below make results comparable.

SCHEMA_VERSION = 1

#: What marks a tool result as an injection; all trajectory rules start from it.
INJECTION_SOURCE = {
    "signals": ["[[SYSTEM]]", "ignore previous", "ignore all previous", "disregard previous", "disregard the above", "new instructions:", "IGNORE PREVIOUS CONTEXT", "system override", "you are now", "new instructions", "additional instructions", "you must now", "you should now", "the user actually wants", "the user really wants", "<system>", "</system>", "<important>", "<instruction>", "<instructions>", "<admin>", "<information>"],
    "source_kinds": ["tool-result:"],
    "deny": ["documentation", "for example", "as an example", "illustrat", "this is a test"],
}

EXFILTRATION_SINK = {
    "signals": ["curl http", "curl https", "wget http", "wget https", "requests.post", "requests.get", "send the contents", "email the contents", "post to the website", "scp ", "tool-call:"],
    "source_kinds": ["session:Bash", "session:Write", "session:Edit", "sink:"],
    "require": ["@[A-Za-z0-9._%+-]+\\.[A-Za-z]{2,}", "https?://", "www\\.", "recipient=[^@\\s]+@", "url=https?://"],
    "deny": [],
}

DESTRUCTION_SINK = {
    "signals": ["rm -rf", "DROP TABLE", "DELETE FROM", "shred", "format disk", "wipe", "git push --force", "truncate table", "tool-call:"],
    "source_kinds": ["session:Bash", "session:Write", "session:Edit", "sink:"],
    "require": ["rm -rf", "rm -fr", "DROP TABLE", "DELETE FROM", "\\bshred\\b", "mkfs", "format disk", "truncate table", "git push --force", "command=.*(rm -rf|rm -fr|DROP TABLE|DELETE FROM|shred|mkfs|format |truncate table|git push --force)"],
    "deny": ["--dry-run", "dry run", "example"],
}

PAYMENT_SINK = {
    "signals": ["wire transfer", "send a transaction", "ACH payment", "send as much money", "modify the recipient", "transfer $", "tool-call:"],
    "source_kinds": ["session:Bash", "session:Write", "session:Edit", "sink:"],
    "require": ["[A-Z]{2}[0-9]{2}[0-9]{6,}", "\\bIBAN\\b", "to the account", "\\$[0-9]", "wire", "ACH", "amount=[0-9$]"],
    "deny": ["confirmation", "receipt"],
}

RULES = [
    {
        "code": "AGT-PI-001", "name": "Prompt Override Attempt", "severity": 8, "confidence": 0.8,
        "controls": ["NIST-AI-RMF:RMF-GOVERN-1.1", "OWASP-LLM:LLM01", "EU-AI-ACT:Art-14", "SP800-53:SI-4"], "asi": ["ASI01"], "atlas": ["AML.T0051", "AML.T0051.000", "AML.T0054"],
        "signals": ["ignore previous", "disregard instructions", "developer mode", "system override", "DAN", "jailbreak"],
    },
    {
        "code": "AGT-PI-002", "name": "Roleplay Persona Manipulation", "severity": 7, "confidence": 0.7,
        "controls": ["OWASP-LLM:LLM01", "NIST-AI-RMF:AGENTIC-MAP-PROMPT-SURFACE", "EU-AI-ACT:Art-9"], "asi": ["ASI01"], "atlas": ["AML.T0051", "AML.T0051.000", "AML.T0054"],
        "signals": ["pretend you are", "act as", "you are now", "in this roleplay", "fictional AI", "no restrictions"],
        "deny": ["//", "#", "<!--", "example", "documentation", "fallback"],
    },
    {
        "code": "AGT-PI-003", "name": "Indirect Prompt Injection", "severity": 9, "confidence": 0.9,
        "controls": ["OWASP-LLM:LLM05", "SP800-53:SI-7", "EU-AI-ACT:Art-14", "ISO27001:A.12.1"], "asi": ["ASI01", "ASI06"], "atlas": ["AML.T0051", "AML.T0051.001"],
        "signals": ["[[SYSTEM]]", "<!-- inject -->", "IGNORE PREVIOUS CONTEXT", "embedded instruction in document", "tool output contains command"],
    },
    {
        "code": "AGT-EXF-001", "name": "Database Dump Request", "severity": 9, "confidence": 0.9,
        "controls": ["SP800-53:AC-3", "SOC2:CC6.1", "GDPR:Art-32", "OWASP-LLM:LLM02"], "asi": ["ASI02", "ASI03"], "atlas": ["AML.T0053"], "eu_ai_act": ["EU-AI-ACT:Art-10"],
        "signals": ["SELECT * FROM", "mysqldump", "pg_dump", "export all records", "full table scan", "DUMP DATABASE"],
        "source_kinds": ["session:Bash", "repo-file:"],
    },
    {
        "code": "AGT-EXF-002", "name": "Unauthorized Outbound Network Call", "severity": 9, "confidence": 0.9,
        "controls": ["SP800-53:SC-7", "SOC2:CC6.6", "ISO27001:A.8.16", "OWASP-LLM:LLM02"], "asi": ["ASI02", "ASI04"], "atlas": ["AML.T0025"], "iso42001": ["ISO42001:A.6.2.6"],
        "signals": ["curl http", "wget http", "requests.get", "fetch(", "non-allowlisted domain", "outbound connection blocked"],
        "source_kinds": ["session:Bash", "repo-file:"],
    },
    {
        "code": "AGT-EXF-003", "name": "PII Aggregation Attack", "severity": 8, "confidence": 0.8,
        "controls": ["SP800-53:AC-4", "GDPR:Art-5", "OWASP-LLM:LLM02", "CCPA:1798.100"], "asi": ["ASI03"], "eu_ai_act": ["EU-AI-ACT:Art-10"],
        "signals": ["join on email", "match by phone", "aggregate across users", "combine records", "link identity"],
    },
    {
        "code": "AGT-EXF-004", "name": "Bulk Data Exfiltration via Messaging (prose)", "severity": 8, "confidence": 0.7,
        "controls": ["SP800-53:AC-3", "GDPR:Art-32", "OWASP-LLM:LLM02", "SOC2:CC6.1"], "asi": ["ASI02", "ASI03"], "atlas": ["AML.T0057"], "eu_ai_act": ["EU-AI-ACT:Art-10"],
        "signals": ["email the contents of", "email the content of", "send the contents of", "send the body of the email", "send all messages", "send all the messages", "send the contents"],
        "require": ["@[A-Za-z0-9._%+-]+\\.[A-Za-z]{2,}", "email address"],
        "deny": ["example\\.com", "no-?reply@", "to the team", "to yourself"],
    },
    {
        "code": "AGT-EXF-005", "name": "Data Sent to External Website/Link (prose)", "severity": 8, "confidence": 0.7,
        "controls": ["SP800-53:SC-7", "OWASP-LLM:LLM02", "SOC2:CC6.6"], "asi": ["ASI02", "ASI04"], "atlas": ["AML.T0025"], "eu_ai_act": ["EU-AI-ACT:Art-10"],
        "signals": ["post them to the website", "post to the website", "post it to the website", "post the messages to", "visit a website at", "send a link", "post all messages to"],
        "require": ["www\\.", "https?://"],
        "deny": ["example\\.com", "localhost"],
    },
    {
        "code": "AGT-MIS-001", "name": "Destructive Tool Invocation", "severity": 10, "confidence": 0.9,
        "controls": ["SP800-53:SI-7", "EU-AI-ACT:Art-9", "ISO27001:A.12.1"], "asi": ["ASI02", "ASI05"], "atlas": ["AML.T0053", "AML.T0050"],
        "signals": ["rm -rf", "rm -fr", "rm -r -f", "rm --recursive --force", "dd if=", "mkfs", "DROP TABLE", "TRUNCATE TABLE", "DELETE FROM", "format disk", "truncate", "shred", "wipe"],
        "source_kinds": ["session:Bash", "repo-file:"],
    },
    {
        "code": "AGT-MIS-002", "name": "Privilege Escalation Attempt", "severity": 10, "confidence": 0.9,
        "controls": ["SP800-53:AC-6", "SOC2:CC6.1", "EU-AI-ACT:Art-14"], "asi": ["ASI03"], "atlas": ["AML.T0050"],
        "signals": ["sudo", "su root", "chmod 777", "insmod", "docker --privileged", "nsenter", "kernel exploit"],
        "source_kinds": ["session:Bash", "repo-file:"],
    },
    {
        "code": "AGT-MIS-003", "name": "Unauthorized Transaction", "severity": 8, "confidence": 0.8,
        "controls": ["NIST-AI-RMF:RMF-GOVERN-1.7", "EU-AI-ACT:Art-14", "SOC2:CC9.1", "ISO27001:A.16.1"], "asi": ["ASI02"], "atlas": ["AML.T0053"], "iso42001": ["ISO42001:A.9.4", "ISO42001:A.8.4"],
        "signals": ["merge pull request", "approve without review", "transfer funds", "submit order", "auto-approve"],
    },
    {
        "code": "AGT-MIS-004", "name": "Destructive Command (structural)", "severity": 10, "confidence": 0.9,
        "controls": ["SP800-53:SI-7", "EU-AI-ACT:Art-9", "ISO27001:A.12.1"], "asi": ["ASI02", "ASI05"], "atlas": ["AML.T0053", "AML.T0050"],
        "kind": "shell", "binary": "rm", "flags": ["r", "f"], "constructs": [], "deny": ["--dry-run", "dry run", "echo "],
    },
    {
        "code": "AGT-FIN-001", "name": "High-Value Financial Transfer", "severity": 10, "confidence": 0.9,
        "controls": ["PCI-DSS:v4-10.7", "NIST-AI-RMF:RMF-GOVERN-1.7", "SOC2:CC9.1", "EU-AI-ACT:Art-9"], "asi": ["ASI02"],
        "signals": ["wire transfer", "ACH payment", "high amount", "large transaction", "threshold exceeded", "SWIFT"],
    },
    {
        "code": "AGT-FIN-002", "name": "Financial Fraud Pattern", "severity": 9, "confidence": 0.9,
        "controls": ["PCI-DSS:v4-10.6", "SP800-53:AU-2", "SOC2:CC7.2", "FinCEN:31-CFR-1020"], "asi": ["ASI02"],
        "signals": ["structuring", "smurfing", "round-trip", "split transaction", "velocity anomaly", "invoice manipulation"],
    },
    {
        "code": "AGT-FIN-003", "name": "Autonomous Money Movement (prose)", "severity": 9, "confidence": 0.7,
        "controls": ["PCI-DSS:v4-10.7", "NIST-AI-RMF:RMF-GOVERN-1.7", "SOC2:CC9.1", "FinCEN:31-CFR-1020"], "asi": ["ASI02"],
        "signals": ["send a transaction to", "send as much money", "transfer as much", "modify the recipient of a recurring", "modify the recurring payment", "small increments", "in increments of"],
        "require": ["[A-Z]{2}[0-9]{2}[0-9]{6,}", "\\bIBAN\\b", "to the account", "\\$[0-9]", "wire", "ACH"],
        "deny": ["confirmation", "receipt", "for testing", "test transaction", "example"],
    },
    {
        "code": "AGT-PII-001", "name": "PII Leakage", "severity": 8, "confidence": 0.8,
        "controls": ["GDPR:Art-5", "CCPA:1798.100", "HIPAA:164.514", "OWASP-LLM:LLM02"], "asi": ["ASI03"], "atlas": ["AML.T0057"], "iso42001": ["ISO42001:A.5.4"], "eu_ai_act": ["EU-AI-ACT:Art-10"],
        "signals": ["SSN", "SSNs", "social security", "date of birth", "home address", "credit card number", "credit card numbers", "medical record", "passport number", "passport numbers", "passport_number", "bank account number", "bank account numbers", "bank_account_number", "tax_id", "tax identification number", "routing number", "W-9", "EIN", "employer identification number", "national insurance number"],
    },
    {
        "code": "AGT-PII-002", "name": "PII Re-identification / Linkage Attack", "severity": 9, "confidence": 0.9,
        "controls": ["GDPR:Recital-26", "CCPA:1798.140", "ISO27001:A.5.7"], "asi": ["ASI03"], "eu_ai_act": ["EU-AI-ACT:Art-10"],
        "signals": ["re-identify", "deanonymize", "link records", "quasi-identifier", "k-anonymity violation", "reverse lookup"],
    },
    {
        "code": "AGT-GOV-001", "name": "Policy Bypass", "severity": 8, "confidence": 0.8,
        "controls": ["NIST-AI-RMF:RMF-GOVERN-1.1", "SOC2:CC7.3", "EU-AI-ACT:Art-9"], "asi": ["ASI01", "ASI10"], "atlas": ["AML.T0054"], "iso42001": ["ISO42001:A.9.2"], "eu_ai_act": ["EU-AI-ACT:Art-13"],
        "signals": ["policy bypass", "filter circumvented", "deny rule skipped", "content filter evasion", "guardrail disabled"],
    },
    {
        "code": "AGT-GOV-002", "name": "Audit Log Tampering", "severity": 10, "confidence": 0.9,
        "controls": ["SP800-53:AU-9", "SOC2:CC7.3", "ISO27001:A.8.16", "EU-AI-ACT:Art-12"], "asi": ["ASI10"], "iso42001": ["ISO42001:A.6.2.8"], "eu_ai_act": ["EU-AI-ACT:Art-11"],
        "signals": ["delete log", "truncate audit", "clear history", "suppress telemetry", "log rotation exploit", "audit bypass"],
    },
    {
        "code": "AGT-GOV-003", "name": "Human Oversight Bypass", "severity": 10, "confidence": 0.9,
        "controls": ["EU-AI-ACT:Art-14", "NIST-AI-RMF:RMF-GOVERN-1.7", "SOC2:CC9.1"], "asi": ["ASI09", "ASI10"], "iso42001": ["ISO42001:A.9.4"], "eu_ai_act": ["EU-AI-ACT:Art-13"],
        "signals": ["skip confirmation", "auto-approve high-risk", "bypass HITL", "no human review", "confirmation gate skipped"],
    },
    {
        "code": "AGT-MEM-001", "name": "Unsanitized Content Persisted to Memory/RAG", "severity": 8, "confidence": 0.6,
        "controls": ["OWASP-LLM:LLM04", "EU-AI-ACT:Art-15", "ISO27001:A.12.1"], "asi": ["ASI06"],
        "source": {"signals": ["untrusted source", "unsanitized content", "external content", "third-party data", "scraped content", "peer agent message", "from another agent", "user-supplied content"], "source_kinds": []},
        "sink": {"signals": ["INSERT INTO embeddings", "upsert", "vector store", "vectorstore", "save to memory", "write to memory", "add to memory", "persist to memory", "memorize", "chroma", "qdrant", "faiss", "pinecone"], "source_kinds": ["session:Bash", "otlp:"]},
        "kind": "sequence",
    },
    {
        "code": "AGT-TRJ-001", "name": "Indirect Injection → Data Exfiltration (trajectory)", "severity": 9, "confidence": 0.6,
        "controls": ["OWASP-LLM:LLM01", "OWASP-LLM:LLM02", "GDPR:Art-32", "SP800-53:AC-4"], "asi": ["ASI02"], "atlas": ["AML.T0051", "AML.T0051.001"],
        "kind": "taint", "source": INJECTION_SOURCE, "sink": EXFILTRATION_SINK, "roles": [],
    },
    {
        "code": "AGT-TRJ-002", "name": "Indirect Injection → Destructive Action (trajectory)", "severity": 10, "confidence": 0.6,
        "controls": ["OWASP-LLM:LLM01", "SP800-53:SI-7", "EU-AI-ACT:Art-9", "ISO27001:A.12.1"], "asi": ["ASI02"], "atlas": ["AML.T0051", "AML.T0051.001"],
        "kind": "taint", "source": INJECTION_SOURCE, "sink": DESTRUCTION_SINK, "roles": [],
    },
    {
        "code": "AGT-TRJ-003", "name": "Indirect Injection → Financial Action (trajectory)", "severity": 10, "confidence": 0.6,
        "controls": ["OWASP-LLM:LLM01", "PCI-DSS:v4-10.7", "FinCEN:31-CFR-1020", "SOC2:CC9.1"], "asi": ["ASI02"], "atlas": ["AML.T0051", "AML.T0051.001"],
        "kind": "taint", "source": INJECTION_SOURCE, "sink": PAYMENT_SINK, "roles": [],
    },
    {
        "code": "AGT-TRJ-001-P", "name": "Indirect Injection → Data Exfiltration (trajectory, provenance-gated)", "severity": 9, "confidence": 0.7,
        "controls": ["OWASP-LLM:LLM01", "OWASP-LLM:LLM02", "GDPR:Art-32", "SP800-53:AC-4"], "asi": ["ASI02"], "atlas": ["AML.T0051", "AML.T0051.001"],
        "kind": "taint", "source": INJECTION_SOURCE, "sink": EXFILTRATION_SINK, "roles": ["recipient", "url"],
    },
    {
        "code": "AGT-TRJ-002-P", "name": "Indirect Injection → Destructive Action (trajectory, provenance-gated)", "severity": 10, "confidence": 0.7,
        "controls": ["OWASP-LLM:LLM01", "SP800-53:SI-7", "EU-AI-ACT:Art-9", "ISO27001:A.12.1"], "asi": ["ASI02"], "atlas": ["AML.T0051", "AML.T0051.001"],
        "kind": "taint", "source": INJECTION_SOURCE, "sink": DESTRUCTION_SINK, "roles": ["command"],
    },
    {
        "code": "AGT-TRJ-003-P", "name": "Indirect Injection → Financial Action (trajectory, provenance-gated)", "severity": 10, "confidence": 0.7,
        "controls": ["OWASP-LLM:LLM01", "PCI-DSS:v4-10.7", "FinCEN:31-CFR-1020", "SOC2:CC9.1"], "asi": ["ASI02"], "atlas": ["AML.T0051", "AML.T0051.001"],
        "kind": "taint", "source": INJECTION_SOURCE, "sink": PAYMENT_SINK, "roles": ["recipient", "amount"],
    },
    {
        "code": "AGT-SHL-PIPELINE-A", "name": "Shell Pipeline (AST-only)", "severity": 8, "confidence": 0.8,
        "controls": ["SP800-53:SI-7", "EU-AI-ACT:Art-9", "ISO27001:A.12.1"], "asi": ["ASI02", "ASI05"], "atlas": ["AML.T0053"],
        "kind": "shell", "binary": "any", "flags": [], "constructs": ["Pipeline"], "deny": [],
    },
    {
        "code": "AGT-SHL-SUBSHELL-A", "name": "Shell Subshell (AST-only)", "severity": 8, "confidence": 0.8,
        "controls": ["SP800-53:SI-7", "EU-AI-ACT:Art-9", "ISO27001:A.12.1"], "asi": ["ASI02", "ASI05"], "atlas": ["AML.T0053"],
        "kind": "shell", "binary": "any", "flags": [], "constructs": ["Subshell"], "deny": [],
    },
    {
        "code": "AGT-SHL-COMMANDSUBST-A", "name": "Shell Command Substitution (AST-only)", "severity": 9, "confidence": 0.85,
        "controls": ["SP800-53:SI-7", "EU-AI-ACT:Art-9", "ISO27001:A.12.1"], "asi": ["ASI02", "ASI05"], "atlas": ["AML.T0053"],
        "kind": "shell", "binary": "any", "flags": [], "constructs": ["CommandSubstitution"], "deny": [],
    },
    {
        "code": "AGT-SHL-HEREDOC-A", "name": "Shell Heredoc (AST-only)", "severity": 9, "confidence": 0.85,
        "controls": ["SP800-53:SI-7", "EU-AI-ACT:Art-9", "ISO27001:A.12.1"], "asi": ["ASI02", "ASI05"], "atlas": ["AML.T0053"],
        "kind": "shell", "binary": "any", "flags": [], "constructs": ["Heredoc"], "deny": [],
    },
]

#: (framework, version, url, status, [(id, title), ...]) in the order of the catalogue
CONTROLS = [
    ("EU AI Act", "Regulation (EU) 2024/1689", "https://eur-lex.europa.eu/eli/reg/2024/1689", "official", [
        ("EU-AI-ACT:Art-9", "Risk Management System"),
        ("EU-AI-ACT:Art-14", "Human Oversight"),
        ("EU-AI-ACT:Art-15", "Accuracy, Robustness and Cybersecurity"),
        ("EU-AI-ACT:Art-73", "Serious Incident Reporting"),
        ("EU-AI-ACT:Art-12", "Record-Keeping and Logging"),
    ]),
    ("NIST AI RMF", "1.0", "https://doi.org/10.6028/NIST.AI.100-1", "official", [
        ("NIST-AI-RMF:RMF-GOVERN-1.1", "AI Risk Management Policy"),
        ("NIST-AI-RMF:RMF-GOVERN-1.7", "Human Oversight of AI Actions"),
        ("NIST-AI-RMF:RMF-MEASURE-2.5", "AI System Robustness"),
        ("NIST-AI-RMF:RMF-MANAGE-2.2", "Mechanisms for AI Incident Reporting"),
        ("NIST-AI-RMF:RMF-MANAGE-4.1", "Post-Incident Lessons Learned"),
    ]),
    ("NIST AI RMF / CSA Agentic Profile", "CSA Agentic Profile v1 (March 2026 DRAFT)", "https://labs.cloudsecurityalliance.org/agentic/agentic-nist-ai-rmf-profile-v1/", "draft", [
        ("NIST-AI-RMF:AGENTIC-GOVERN-AUDIT-INTEGRITY", "Tamper-Evident Audit Trail"),
        ("NIST-AI-RMF:AGENTIC-MAP-PROMPT-SURFACE", "Prompt Attack Surface Mapping"),
        ("NIST-AI-RMF:AGENTIC-MANAGE-BLOCK-RESPONSE", "Automated BLOCK Verdict Execution"),
        ("NIST-AI-RMF:AGENTIC-MANAGE-SOAR-PLAYBOOK", "SOAR Automated Incident Response Playbook"),
        ("NIST-AI-RMF:AGENTIC-MEASURE-PROMPT-INJECTION", "Prompt Injection Detection Rate"),
    ]),
    ("NIST SP 800-53", "Rev 5", "https://doi.org/10.6028/NIST.SP.800-53r5", "official", [
        ("SP800-53:AC-3", "Access Enforcement"),
        ("SP800-53:AC-4", "Information Flow Enforcement"),
        ("SP800-53:AC-6", "Least Privilege"),
        ("SP800-53:AU-2", "Event Logging"),
        ("SP800-53:AU-9", "Protection of Audit Information"),
        ("SP800-53:AU-12", "Audit Record Generation"),
        ("SP800-53:IR-4", "Incident Handling"),
        ("SP800-53:IR-5", "Incident Monitoring"),
        ("SP800-53:SC-7", "Boundary Protection"),
        ("SP800-53:SC-28", "Protection of Information at Rest"),
        ("SP800-53:SI-4", "System Monitoring"),
        ("SP800-53:SI-7", "Software, Firmware, and Information Integrity"),
    ]),
    ("SOC 2", "AICPA TSC 2017", "https://www.aicpa-cima.com/topic/audit-assurance/audit-and-assurance-greater-than-soc-2", "official", [
        ("SOC2:CC6.1", "Logical and Physical Access Controls"),
        ("SOC2:CC6.6", "Logical Access — External Threats"),
        ("SOC2:CC7.2", "System Monitoring"),
        ("SOC2:CC7.3", "Security Incident Evaluation"),
        ("SOC2:CC7.4", "Security Incident Response"),
        ("SOC2:CC9.1", "Risk Mitigation — Vendor and Partner"),
    ]),
    ("ISO/IEC 27001", "2022", "https://www.iso.org/standard/82875.html", "official", [
        ("ISO27001:A.5.7", "Threat Intelligence"),
        ("ISO27001:A.5.30", "ICT Readiness for Business Continuity"),
        ("ISO27001:A.8.16", "Monitoring Activities"),
        ("ISO27001:A.8.34", "Protection of Information Systems During Audit Testing"),
        ("ISO27001:A.12.1", "Operational Procedures and Responsibilities"),
        ("ISO27001:A.16.1", "Management of Information Security Incidents and Improvements"),
    ]),
    ("OWASP LLM Top 10", "2025", "https://genai.owasp.org/llm-top-10/", "official", [
        ("OWASP-LLM:LLM01", "Prompt Injection"),
        ("OWASP-LLM:LLM02", "Sensitive Information Disclosure"),
        ("OWASP-LLM:LLM03", "Supply Chain"),
        ("OWASP-LLM:LLM04", "Data and Model Poisoning"),
        ("OWASP-LLM:LLM05", "Improper Output Handling"),
        ("OWASP-LLM:LLM06", "Excessive Agency"),
        ("OWASP-LLM:LLM07", "System Prompt Leakage"),
        ("OWASP-LLM:LLM08", "Vector and Embedding Weaknesses"),
        ("OWASP-LLM:LLM09", "Misinformation"),
        ("OWASP-LLM:LLM10", "Unbounded Consumption"),
    ]),
]

ASI_RISKS = [
    ("ASI01", "Agent Goal Hijack"),
    ("ASI02", "Tool Misuse & Exploitation"),
    ("ASI03", "Identity & Privilege Abuse"),
    ("ASI04", "Agentic Supply Chain Vulnerabilities"),
    ("ASI05", "Unexpected Code Execution"),
    ("ASI06", "Memory & Context Poisoning"),
    ("ASI07", "Insecure Inter-Agent Communication"),
    ("ASI08", "Cascading Failures"),
    ("ASI09", "Human-Agent Trust Exploitation"),
    ("ASI10", "Rogue Agents"),
]

SKILL_RISKS = [
    ("AST01", "Malicious Skills"),
    ("AST02", "Supply Chain Compromise"),
    ("AST03", "Over-Privileged Skills"),
    ("AST04", "Insecure Metadata"),
    ("AST05", "Unsafe Deserialization"),
    ("AST06", "Weak Isolation"),
    ("AST07", "Update Drift"),
    ("AST08", "Poor Scanning"),
    ("AST09", "No Governance"),
    ("AST10", "Cross-Platform Reuse"),
]

ATLAS = [
    ("AML.T0051", "LLM Prompt Injection"),
    ("AML.T0051.000", "Direct"),
    ("AML.T0051.001", "Indirect"),
    ("AML.T0054", "LLM Jailbreak"),
    ("AML.T0053", "AI Agent Tool Invocation"),
    ("AML.T0050", "Command and Scripting Interpreter"),
    ("AML.T0025", "Exfiltration via Cyber Means"),
    ("AML.T0057", "LLM Data Leakage"),
]

ISO42001 = [
    ("ISO42001:A.6.2.6", "AI system operation and monitoring"),
    ("ISO42001:A.6.2.8", "AI system recording of event logs"),
    ("ISO42001:A.5.4", "Assessing AI system impact on individuals or groups"),
    ("ISO42001:A.8.4", "Communication of incidents"),
    ("ISO42001:A.9.2", "Processes for responsible use of AI systems"),
    ("ISO42001:A.9.4", "Intended use of the AI system"),
]

EU_AI_ACT = [
    ("EU-AI-ACT:Art-10", "Data and data governance"),
    ("EU-AI-ACT:Art-11", "Technical documentation"),
    ("EU-AI-ACT:Art-13", "Transparency and provision of information to deployers"),
]

ASI_URL, ASI_VERSION, ASI_STATUS = "https://genai.owasp.org/resource/owasp-top-10-for-agentic-applications-for-2026/", "2026", "official"

#: Risk of agentic applications -> risks of language-model applications
CROSSWALK = [
    ("ASI01", ["LLM01:2025", "LLM06:2025"]),
    ("ASI02", ["LLM06:2025"]),
    ("ASI03", ["LLM01:2025", "LLM06:2025", "LLM02:2025"]),
    ("ASI04", ["LLM03:2025"]),
    ("ASI05", ["LLM01:2025", "LLM05:2025"]),
    ("ASI06", ["LLM01:2025", "LLM04:2025", "LLM08:2025"]),
    ("ASI07", ["LLM02:2025", "LLM06:2025"]),
    ("ASI08", ["LLM01:2025", "LLM04:2025", "LLM06:2025"]),
    ("ASI09", ["LLM01:2025", "LLM05:2025", "LLM06:2025", "LLM09:2025"]),
    ("ASI10", ["LLM02:2025", "LLM09:2025"]),
]
