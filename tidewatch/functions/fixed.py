"""Fixed values that results depend on: names, weights, lists and thresholds, stated plainly."""

# Severities and their ranks.
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}

# Kill-chain stages in order.
STAGES = ("RECONNAISSANCE", "DELIVERY", "COMMAND_AND_CONTROL", "EXFILTRATION", "ACTIONS_ON_OBJECTIVES")

# Stage of an alert when alerts are fused, by upper-cased threat class or lower-cased detector.
FUSION_STAGE = {
    "portscan_hll": "RECONNAISSANCE",
    "port_scan": "RECONNAISSANCE",
    "recon_sweep": "RECONNAISSANCE",
    "PORT_SCAN_RECON": "RECONNAISSANCE",
    "dga_lstm": "DELIVERY",
    "dga_tunneling": "DELIVERY",
    "DGA_TUNNELLING": "DELIVERY",
    "dns_tunnel": "DELIVERY",
    "ja4_malware": "COMMAND_AND_CONTROL",
    "encrypted_malware": "COMMAND_AND_CONTROL",
    "ENCRYPTED_MALWARE": "COMMAND_AND_CONTROL",
    "c2_beacon": "COMMAND_AND_CONTROL",
    "c2_beaconing": "COMMAND_AND_CONTROL",
    "C2_BEACONING": "COMMAND_AND_CONTROL",
    "exfil_ratio": "EXFILTRATION",
    "data_exfiltration": "EXFILTRATION",
    "DATA_EXFILTRATION": "EXFILTRATION",
    "ddos_entropy": "ACTIONS_ON_OBJECTIVES",
    "volumetric_ddos": "ACTIONS_ON_OBJECTIVES",
    "VOLUMETRIC_DDOS": "ACTIONS_ON_OBJECTIVES",
    "protocol_ddos": "ACTIONS_ON_OBJECTIVES",
}

# Stage of an alert on the triage timeline, by threat class or detector; EXECUTION otherwise.
TIMELINE_STAGE = {
    "PORT_SCAN_RECON": "RECONNAISSANCE",
    "port_scan": "RECONNAISSANCE",
    "recon_sweep": "RECONNAISSANCE",
    "DGA_TUNNELLING": "WEAPONIZATION",
    "dga_lstm": "WEAPONIZATION",
    "ENCRYPTED_MALWARE": "COMMAND_AND_CONTROL",
    "ja4_malware": "COMMAND_AND_CONTROL",
    "C2_BEACONING": "COMMAND_AND_CONTROL",
    "c2_beacon": "COMMAND_AND_CONTROL",
    "DATA_EXFILTRATION": "EXFILTRATION",
    "exfil_ratio": "EXFILTRATION",
    "VOLUMETRIC_DDOS": "IMPACT",
    "PROTOCOL_DDOS": "IMPACT",
    "ddos_entropy": "IMPACT",
}

# Technique that a fused incident hints at when an alert names none.
TECHNIQUE_HINT = {
    "portscan_hll": "T1595",
    "port_scan": "T1595",
    "recon_sweep": "T1595.002",
    "PORT_SCAN_RECON": "T1595",
    "dga_lstm": "T1568.002",
    "dga_tunneling": "T1568.002",
    "DGA_TUNNELLING": "T1568.002",
    "ja4_malware": "T1071.001",
    "encrypted_malware": "T1071.001",
    "ENCRYPTED_MALWARE": "T1071.001",
    "c2_beacon": "T1071",
    "c2_beaconing": "T1071",
    "C2_BEACONING": "T1071",
    "exfil_ratio": "T1048",
    "data_exfiltration": "T1048",
    "DATA_EXFILTRATION": "T1048",
    "ddos_entropy": "T1498",
    "volumetric_ddos": "T1498",
    "VOLUMETRIC_DDOS": "T1498",
    "protocol_ddos": "T1499",
}

# One name for each threat in risk scoring. The second table adds the spellings that detectors emit.
CANONICAL_THREAT = {
    "c2_beaconing": "C2_BEACONING",
    "c2_beacon": "C2_BEACONING",
    "encrypted_malware": "ENCRYPTED_MALWARE",
    "ja4_malware": "ENCRYPTED_MALWARE",
    "exfil_ratio": "DATA_EXFILTRATION",
    "dga_tunneling": "DGA_TUNNELLING",
    "dga_lstm": "DGA_TUNNELLING",
    "ddos_entropy": "VOLUMETRIC_DDOS",
    "portscan_hll": "PORT_SCAN_RECON",
    "port_scan": "PORT_SCAN_RECON",
    "recon_sweep": "PORT_SCAN_RECON",
}
CANONICAL_EMITTED = {"volumetric_ddos": "VOLUMETRIC_DDOS", "protocol_ddos": "PROTOCOL_DDOS", "data_exfiltration": "DATA_EXFILTRATION"}

# Base weights of risk; 20 otherwise.
RISK_WEIGHT = {
    "C2_BEACONING": 40.0,
    "ENCRYPTED_MALWARE": 40.0,
    "DATA_EXFILTRATION": 35.0,
    "DGA_TUNNELLING": 30.0,
    "VOLUMETRIC_DDOS": 30.0,
    "PROTOCOL_DDOS": 30.0,
    "PORT_SCAN_RECON": 15.0,
}
OTHER_WEIGHT = 20.0

# How critical an asset is, by role.
ROLE_CRITICALITY = {
    "INTERNAL_WORKSTATION": 1.0,
    "WORKSTATION": 1.0,
    "USER_ENDPOINT": 1.0,
    "APP_SERVER": 1.25,
    "INTERNAL_SERVER": 1.25,
    "WEB_SERVER": 1.25,
    "DATABASE_SERVER": 1.5,
    "PROD_DB": 1.5,
    "DOMAIN_CONTROLLER": 1.75,
    "AUTH_SERVER": 1.75,
    "LDAP_SERVER": 1.75,
    "GATEWAY_FIREWALL": 2.0,
    "DIODE_ROOT": 2.0,
    "CRITICAL_ENCLAVE": 2.0,
    "INFRASTRUCTURE_ROUTER": 2.0,
}

# Roles that an address's end suggests.
ROLE_BY_SUFFIX = ((".1", "GATEWAY_FIREWALL"), (".254", "GATEWAY_FIREWALL"), (".10", "DOMAIN_CONTROLLER"), (".11", "DOMAIN_CONTROLLER"), (".50", "DATABASE_SERVER"), (".51", "DATABASE_SERVER"), (".80", "APP_SERVER"), (".443", "APP_SERVER"))

# Techniques (id, name, tactic id, tactic, kill-chain phase) and the keys that lead to them.
TECHNIQUES = {
    "scan": ("T1595.001", "Active Scanning: Port Scanning", "TA0043", "Reconnaissance", "Reconnaissance"),
    "sweep": ("T1595.002", "Active Scanning: Vulnerability Scanning", "TA0043", "Reconnaissance", "Reconnaissance"),
    "dga": ("T1568.002", "Dynamic Resolution: Domain Generation Algorithms", "TA0011", "Command and Control", "Weaponization & Delivery"),
    "malware": ("T1071.001", "Application Layer Protocol: Web Protocols", "TA0011", "Command and Control", "Installation & Execution"),
    "beacon": ("T1071.001", "Application Layer Protocol: Web Protocols", "TA0011", "Command and Control", "Command and Control"),
    "exfil": ("T1048.002", "Exfiltration Over Alternative Protocol: Asymmetric Flow", "TA0010", "Exfiltration", "Actions on Objectives"),
    "ddos": ("T1498.001", "Network Denial of Service: Direct Network Flood", "TA0040", "Impact", "Impact"),
    "other": ("T1595", "Active Scanning", "TA0043", "Reconnaissance", "Reconnaissance"),
}
TECHNIQUE_KEYS = {
    "PORT_SCAN_RECON": ("scan", "portscan_hll"),
    "port_scan": ("scan", "portscan_hll"),
    "portscan_hll": ("scan", "portscan_hll"),
    "recon_sweep": ("sweep", "portscan_hll"),
    "DGA_TUNNELLING": ("dga", "dga_tunneling"),
    "dga_tunneling": ("dga", "dga_tunneling"),
    "dga_lstm": ("dga", "dga_lstm"),
    "ENCRYPTED_MALWARE": ("malware", "encrypted_malware"),
    "encrypted_malware": ("malware", "encrypted_malware"),
    "ja4_malware": ("malware", "ja4_malware"),
    "C2_BEACONING": ("beacon", "c2_beaconing"),
    "c2_beaconing": ("beacon", "c2_beaconing"),
    "c2_beacon": ("beacon", "c2_beaconing"),
    "DATA_EXFILTRATION": ("exfil", "exfil_ratio"),
    "exfil_ratio": ("exfil", "exfil_ratio"),
    "VOLUMETRIC_DDOS": ("ddos", "ddos_entropy"),
    "PROTOCOL_DDOS": ("ddos", "ddos_entropy"),
    "ddos_entropy": ("ddos", "ddos_entropy"),
}

# Threat classes by kind, upper-cased, for the intent of an incident.
INTENT_CLASSES = {
    "recon": ("PORT_SCAN_RECON", "PORT_SCAN", "RECON_SWEEP"),
    "dga": ("DGA_TUNNELLING", "DGA_LSTM"),
    "malware": ("ENCRYPTED_MALWARE", "JA4_MALWARE"),
    "c2": ("C2_BEACONING", "C2_BEACON"),
    "exfil": ("DATA_EXFILTRATION", "EXFIL_RATIO"),
    "ddos": ("VOLUMETRIC_DDOS", "PROTOCOL_DDOS", "DDOS_ENTROPY"),
}

# Domains whose names are never taken for generated ones, with their subdomains.
BENIGN_DOMAINS = (
    "google.com youtube.com facebook.com amazon.com wikipedia.org microsoft.com linkedin.com apple.com github.com cloudflare.com "
    "bing.com office.com adobe.com spotify.com dropbox.com medium.com quora.com cnn.com nytimes.com bbc.co.uk "
    "stackoverflow.com gitlab.com docker.com mozilla.org apache.org in-addr.arpa ip6.arpa local internal lan home.arpa"
).split()
SCORE_BENIGN_DOMAINS = "google.com youtube.com amazon.com facebook.com wikipedia.org microsoft.com github.com netflix.com apple.com twitter.com reddit.com cloudflare.com cloudfront.net akamai.com".split()
SCORE_BENIGN_LABELS = "google youtube amazon facebook wikipedia microsoft github netflix apple twitter reddit portal cloud secure network system service".split()
SCORE_TLDS = "com net org biz info ru cn top xyz cc".split()
RARE_BIGRAMS = "xk qj xw vj px kq kd mw zx qw zf hx lx wj jz qx".split()
#: Symbols of the domain tokenizer, numbered from 2; 0 pads and 1 stands for all others.
DOMAIN_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789-_./:@#"

# Names in TLS handshakes that raise a score.
TLS_DN_WORDS = "localhost test metasploit sliver c2 snakeoil temporary kali cobalt default evil".split()
TLS_DYNAMIC_DNS = "duckdns.org ngrok.io hopto.org no-ip.biz ddns.net zapto.org".split()
TLS_RISKY_TLDS = ".tk .xyz .top .club .pw .cc .su .ru .cn".split()
TLS_WEAK_CIPHERS = "rc4 3des des null export md5 anon rc2".split()

# TLS fingerprints of malware families, in order; a later family takes over a fingerprint named twice.
FAMILIES = (
    ("Cobalt Strike", "CRITICAL", 0.95, "T1071.001", "t13d1516h2_8daaf6152771_e5627efa2ab1 t12d1408h1_8daaf6152771_000000000000 t13d1516h2_8daaf6152771_000000000000", "t1302h2_1301_0000 t1202h1_c02f_000000000000 t130200_1301_0000"),
    ("Sliver", "CRITICAL", 0.95, "T1071.001", "t10i010000_000400000000_000000000000 t13d2112h2_8daaf6152771_b18509e3343c t13i191000_8daaf6152771_b18509e3343c", "t1303h2_1301_0000 t130200_1301_0000"),
    ("Emotet", "CRITICAL", 0.92, "T1071.001", "t12d080000_c02f009e0035_000000000000 t12d1708h1_c02f009e0035_903332fe4076 t12i080000_c02f009e0035_000000000000", "t1202h1_c02f_000000000000"),
    ("LockBit", "CRITICAL", 0.96, "T1486", "t13d190900_9b83b6c20577_1e680459d298 t12i120000_c02f009e0035_000000000000", ""),
    ("AsyncRAT", "HIGH", 0.90, "T1219", "t12i050000_c02bc02f009e_000000000000 t12d080000_c02bc02f009e_000000000000", ""),
    ("Trickbot", "CRITICAL", 0.94, "T1071.001", "t12d1408h1_c02bc02f009e_000000000000 t13d181000_8daaf6152771_000000000000", ""),
    ("Metasploit Meterpreter", "HIGH", 0.92, "T1071.001", "t12i010000_000400000000_000000000000", ""),
)
BENIGN_JA4 = (
    ("Google Chrome (Windows/macOS TLS 1.3)", "t13d1516h2_8daaf6152771_b18509e3343c"),
    ("Mozilla Firefox (TLS 1.3)", "t13d1715h2_5a7886717da7_b18509e3343c"),
    ("Apple Safari (iOS / macOS TLS 1.3)", "t13d1912h2_2b4502018804_b18509e3343c"),
    ("Python Requests / Urllib3", "t13d1516h2_8daaf6152771_da39a3ee5e6b"),
    ("cURL CLI", "t13d1516h2_8daaf6152771_903332fe4076"),
)

# Of HyperLogLog++ with 2,048 registers: raw estimates from 2.5 times their number on, and their mean biases.
SKETCH_RAW = (4589.1816, 4632.5188, 4678.2294, 4724.8908, 4769.0194, 4817.052, 4861.4588, 4910.1596, 4956.4344, 5002.5238, 5048.13, 5093.6374, 5142.8162, 5187.7894, 5237.3984, 5285.6078, 5331.0858, 5379.1036, 5428.6258, 5474.6018, 5522.7618, 5571.5822, 5618.59, 5667.9992, 5714.88, 5763.454, 5808.6982, 5860.3644, 5910.2914, 5953.571, 6005.9232, 6055.1914, 6104.5882, 6154.5702, 6199.7036, 6251.1764, 6298.7596, 6350.0302, 6398.061, 6448.4694, 6495.933, 6548.0474, 6597.7166, 6646.9416, 6695.9208, 6742.6328, 6793.5276, 6842.1934, 6894.2372, 6945.3864, 6996.9228, 7044.2372, 7094.1374, 7142.2272, 7192.2942, 7238.8338, 7288.9006, 7344.0908, 7394.8544, 7443.5176, 7490.4148, 7542.9314, 7595.6738, 7641.9878, 7694.3688, 7743.0448, 7797.522, 7845.53, 7899.594, 7950.3132, 7996.455, 8050.9442, 8092.9114, 8153.1374, 8197.4472, 8252.8278, 8301.8728, 8348.6776, 8401.4698, 8453.551, 8504.6598, 8553.8944, 8604.1276, 8657.6514, 8710.3062, 8758.908, 8807.8706, 8862.1702, 8910.4668, 8960.77, 9007.2766, 9063.164, 9121.0534, 9164.1354, 9218.1594, 9267.767, 9319.0594, 9372.155, 9419.7126, 9474.3722, 9520.1338, 9572.368, 9622.7702, 9675.8448, 9726.5396, 9778.7378, 9827.6554, 9878.1922, 9928.7782, 9978.3984, 10026.578, 10076.5626, 10137.1618, 10177.5244, 10229.9176)
SKETCH_BIAS = (186.1816, 178.5188, 172.2294, 167.8908, 161.0194, 158.052, 151.4588, 148.1596, 143.4344, 138.5238, 133.13, 127.6374, 124.8162, 118.7894, 117.3984, 114.6078, 109.0858, 105.1036, 103.6258, 98.6018, 95.7618, 93.5822, 88.59, 86.9992, 82.88, 80.454, 74.6982, 74.3644, 73.2914, 65.571, 66.9232, 65.1914, 62.5882, 61.5702, 55.7036, 56.1764, 52.7596, 53.0302, 49.061, 48.4694, 44.933, 46.0474, 44.7166, 41.9416, 39.9208, 35.6328, 35.5276, 33.1934, 33.2372, 33.3864, 33.9228, 30.2372, 29.1374, 25.2272, 24.2942, 19.8338, 18.9006, 23.0908, 21.8544, 19.5176, 15.4148, 16.9314, 18.6738, 12.9878, 14.3688, 12.0448, 15.522, 12.53, 14.594, 14.3132, 9.455, 12.9442, 3.9114, 13.1374, 5.4472, 9.8278, 7.8728, 3.6776, 5.4698, 5.551, 5.6598, 3.8944, 3.1276, 5.6514, 6.3062, 3.908, 1.8706, 5.1702, 2.4668, 0.77, -3.7234, 1.164, 8.0534, 0.1354, 2.1594, 0.767, 1.0594, 3.155, -0.2874, 2.3722, -2.8662, -1.632, -2.2298, -0.1552, -1.4604, -0.2622, -2.3446, -2.8078, -3.2218, -5.6016, -8.422, -9.4374, 0.1618, -10.4756, -10.0824)
