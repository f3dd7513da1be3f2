"""The ordered rules that place a player of the older tier shape.

Inside a tier the first rule that fits wins. Words are plain substrings of the
lower-case product (blanks count), companies are whole lower-case names. A rule
with a note is flagged for review. The sector ``None`` of a power or thermal
placement is read from that domain's own list below.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    tier: str
    kind: str
    slug: str
    sector: str | None
    any_of: tuple[str, ...] = ()
    also_any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    company: tuple[str, ...] = ()
    note: str = ""
    mirror: tuple[str, str, str] | None = None


# --- Fixed values: company names ---------------------------------------------------
BIG_CLOUD = ("microsoft", "amazon web services", "google", "oracle", "meta", "huawei cloud")
COOLING = (
    "coolit systems", "asetek", "liquidstack", "submer", "nidec", "modine", "munters",
    "fläktgroup", "flaktgroup", "trane technologies", "johnson controls", "alfa laval",
)
POWER = (
    "vertiv", "eaton", "schneider electric", "ge vernova", "abb", "hitachi energy",
    "siemens energy", "legrand", "hd hyundai electric", "ls electric", "sanil electric",
    "mitsubishi heavy industries", "constellation energy", "bloom energy", "fluence energy",
    "delta electronics", "lite-on", "vicor", "monolithic power systems", "navitas",
    "power integrations", "wolfspeed", "nvent",
)
APPS = ("cursor", "perplexity")
ODM = (
    "foxconn", "quanta", "wistron", "pegatron", "wiwynn", "inventec", "compal", "celestica",
    "jabil", "gigabyte", "chenbro", "flex",
)

# --- Fixed values: sectors of the thermal and power domains ------------------------
THERMAL_DEFAULT = "Direct-to-Chip Liquid"
THERMAL_SECTORS = (
    ("Immersion", ("immersion",)),
    ("Two-Phase", ("two-phase",)),
    ("TIM", ("tim", "thermal interface")),
    ("Heat Exchanger / CDU", ("heat exchanger", "brazed-plate", "cdu core")),
    ("Direct-to-Chip Liquid", ("cold plate", "direct-to-chip", "direct to chip", "cdu",
                               "liquid cooling", "cold plates")),
    ("Air Cooling", ("chiller", "crah", "hvac", "air-handling", "air treatment", "evaporative",
                     "air cooling")),
)
POWER_DEFAULT = "Datacenter Power"
POWER_SECTORS = (
    ("Power Semiconductors", ("mosfet", "sic ", "sic modules", "sic power", "gan", "pmic", "vrm",
                              "voltage regulator", "power management", "gate driver", "dc-dc",
                              "optimos", "factorized power", "multiphase", "hot-swap",
                              "intermediate bus", "power ic", "power-conversion",
                              "power conversion")),
    ("Power Semiconductors", ("mlcc", "passive", "capacitor", "resistor")),
    ("Generation", ("nuclear", "gas", "turbine", "fuel cell", "battery", "bess",
                    "energy storage", "generation", "powered-land", "smr")),
    ("Grid", ("transformer", "switchgear", "grid", "hvdc", "substation", "electrical steel",
              "goes", "medium-voltage")),
    ("Datacenter Power", ("ups", "pdu", "busbar", "busway", "psu", "power shelf",
                          "power shelves", "power supply", "power supplies", "rack power", "48v",
                          "power distribution")),
)

# --- Fixed values: recurring sector names ------------------------------------------
_WLP = "Wafer-Level Packaging (CoWoS, SoIC)"
_LOGIC = "Leading-Edge Logic Foundry (2nm/3nm)"
_COMPOUND = "Compound Semi Foundry (GaN/SiC/InP)"
_ASIC = "Custom AI ASIC (hyperscaler silicon)"
_GASES = "Specialty / Process Gases"
_ABF = "Substrate Materials (ABF/BT)"

# --- Fixed values: the rules -------------------------------------------------------
RULES = (
    Rule("ai_lab", "layer", "application", "AI-Native Vertical Apps", company=APPS,
         note="was ai_lab; looks like an AI-native app, not a model maker"),
    Rule("ai_lab", "layer", "ai_models", "Foundation Models"),

    Rule("hyperscaler", "layer", "cloud_infra", "Hyperscaler Cloud", company=BIG_CLOUD),
    Rule("hyperscaler", "layer", "cloud_infra", "Neocloud (GPU-specialized)"),

    Rule("power", "domain", "power", None),
    Rule("software", "layer", "software_infra", "Inference Optimization Stack"),

    Rule("equipment", "layer", "equipment", "Compound Semi Equipment", ("mocvd",)),
    Rule("equipment", "layer", "equipment", "Compound Semi Equipment", company=("aixtron",)),
    Rule("equipment", "layer", "equipment", "MLCC / Passives Equipment",
         ("tape-casting", "lamination", "co-firing", "screen-print"),
         note="passive-component manufacturing equipment (no PDF sector)"),
    Rule("equipment", "layer", "equipment", "MLCC / Passives Equipment",
         company=("sacmi", "asada"),
         note="passive-component manufacturing equipment (no PDF sector)"),
    Rule("equipment", "layer", "equipment", "Lithography",
         ("litho", "euv", "duv", "scanner", "nil", "mask", "reticle")),
    Rule("equipment", "layer", "equipment", "Lithography", company=("lasertec",)),
    Rule("equipment", "layer", "equipment", "Metrology / Inspection",
         ("inspection", "metrology", "process control", "defect", "prober", "probe card",
          "tester", "handler", "socket", "test pins", "test sockets", "test systems",
          "test equipment", "test consumables")),
    Rule("equipment", "layer", "equipment", "Deposition & Etch",
         ("deposition", "etch", "cmp", "coater", "developer", "wet-processing", "cvd", "pvd",
          "ald")),
    Rule("equipment", "layer", "equipment", "Advanced Packaging Equipment",
         ("bonder", "bonding", "tcb", "thermo-compression", "dicing", "grinding", "molding",
          "rdl", "tsv via", "via-drilling", "plating", "die-attach", "debonder", "reflow",
          "descum", "annealing", "marking"),
         note="packaging/bonding tool (no exact PDF sector)"),
    Rule("equipment", "layer", "equipment", "Deposition & Etch"),

    Rule("epiwafer", "layer", "memory", "NAND Flash", ("nand",)),
    Rule("epiwafer", "layer", "foundry", _COMPOUND, ("gan", "sic"), ("foundry", "fab")),
    Rule("epiwafer", "layer", "interconnect", "Components",
         ("eml", "cw laser", "dfb", "laser epiwafer", "laser chips")),
    Rule("epiwafer", "layer", "materials", "InP Wafers", ("inp", "gaas", "epiwafer", "epitaxy")),
    Rule("epiwafer", "layer", "foundry", _LOGIC,
         ("logic wafer", "logic wafers", "front-end", "n3", "n2", "n5", "18a", "4np",
          "advanced node")),
    Rule("epiwafer", "layer", "foundry", _LOGIC, note="was epiwafer; unclear role"),

    Rule("packaging", "layer", "memory", "NAND Flash", ("ssd", "nvme"), none_of=("controller",)),
    Rule("packaging", "layer", "interconnect", "Components",
         ("optical module", "optical transceiver", "transceiver")),
    Rule("packaging", "layer", "advanced_packaging", "HBM Stacking & Bonding",
         ("hbm stack", "tc bonder", "hbm bonding")),
    Rule("packaging", "layer", "advanced_packaging", _WLP,
         ("cowos", "soic", "foveros", "emib", "i-cube", "x-cube", "2.5d", "3d", "interposer",
          "wafer-level", "wafer level", "sip")),
    Rule("packaging", "layer", "foundry", "OSAT (assembly & test)",
         ("osat", "assembly", "test", "flip-chip", "flip chip")),
    Rule("packaging", "layer", "equipment", "Advanced Packaging Equipment", ("packaging line",),
         note="OCS packaging line = equipment"),
    Rule("packaging", "layer", "compute_hardware", "Server CPU", ("epyc", "cpu")),
    Rule("packaging", "layer", "compute_hardware", "Training GPU",
         ("superchip", "grace-hopper", "blackwell superchip")),
    Rule("packaging", "layer", "advanced_packaging", _WLP, note="was packaging; unclear"),

    Rule("switch_system", "domain", "thermal", None, company=COOLING),
    Rule("switch_system", "domain", "thermal", None,
         ("cool", "cold plate", "immersion", "cdu", "chiller", "thermal")),
    Rule("switch_system", "domain", "power", None, company=POWER),
    Rule("switch_system", "domain", "power", None,
         ("ups", "transformer", "switchgear", "pdu", "busway", "power transformer", "grid",
          "turbine")),
    Rule("switch_system", "layer", "compute_hardware", "Training GPU", ("gpu",),
         ("platform", "systems", "superchip", "b200", "gb200", "gb300", "rubin", "instinct")),
    Rule("switch_system", "layer", "compute_hardware", _ASIC, ("ultraserver", "trainium")),
    Rule("switch_system", "layer", "interconnect", "Components",
         ("co-packaged optics", "co-packaged", "cpo", "photonics switch")),
    Rule("switch_system", "layer", "interconnect", "Scale-across",
         ("coherent", "dci", "dwdm", "metro", "wavelogic", "long-haul", "transport")),
    Rule("switch_system", "layer", "interconnect", "Scale-up",
         ("nvlink", "infinity fabric", "ualink", "pcie", "cxl", "scale-up", "neuronlink")),
    Rule("switch_system", "layer", "interconnect", "Scale-out",
         ("ethernet", "infiniband", "tomahawk", "jericho", "spectrum", "quantum", "silicon one",
          "scale-out", "etherlink")),
    Rule("switch_system", "layer", "interconnect", "Components"),

    Rule("oem", "layer", "compute_hardware", _ASIC,
         ("xpu", "asic", "accelerator", "gpu accelerator"), company=("broadcom",)),
    Rule("oem", "layer", "compute_hardware", "Training GPU",
         ("xpu", "asic", "accelerator", "gpu accelerator"), company=("nvidia", "amd")),
    Rule("oem", "layer", "cloud_infra", "Datacenter Colocation",
         ("colocation", "data-center campus", "data center campus", "campuses",
          "powered infrastructure", "data-center colocation")),
    Rule("oem", "domain", "power", None, company=POWER),
    Rule("oem", "domain", "power", None,
         ("psu", "power shelf", "power shelves", "power supplies", "rack power")),
    Rule("oem", "domain", "thermal", None, ("thermal",), none_of=("rack systems",)),
    Rule("oem", "layer", "system_integration", "Networking Systems",
         ("switch system", "ethernet switch", "switch systems", "networking")),
    Rule("oem", "layer", "interconnect", "Components",
         ("co-packaged optics", "silicon photonics", "cpo"), company=("mediatek",),
         mirror=("layer", "compute_hardware", "Networking ASIC")),
    Rule("oem", "layer", "interconnect", "Components", ("fiber network", "fiber carrier"),
         note="fiber network carrier"),
    Rule("oem", "layer", "interconnect", "Components",
         ("silicon photonics", "co-packaged optics", "optical networking", "cpo"),
         note="optical system integration"),
    Rule("oem", "layer", "system_integration", "Server ODM", company=ODM),
    Rule("oem", "layer", "system_integration", "Server / Rack OEM"),

    Rule("component", "layer", "memory", "HBF", ("hbf",)),
    Rule("component", "layer", "memory", "HBM", ("hbm",)),
    Rule("component", "layer", "memory", "LPDDR", ("lpddr",)),
    Rule("component", "layer", "memory", "NAND Flash", ("nand", "v-nand", "3d nand", "bics")),
    Rule("component", "layer", "memory", "Nearline HDD", ("hdd", "nearline", "hamr"),
         note="HDD has no PDF memory sector"),
    Rule("component", "layer", "memory", "NAND Flash", ("ssd", "nvme"), ("controller",)),
    Rule("component", "layer", "memory", "NAND Flash", ("ssd",)),
    Rule("component", "layer", "memory", "DRAM",
         ("rcd", "rdimm", "mrdimm", "socamm", "memory-interface", "register", "dram")),
    Rule("component", "domain", "power", None,
         ("mlcc", "passive", "vrm", "pmic", "mosfet", "voltage regulator", "gate driver",
          "power mosfet", "power management", "optimos", "factorized power", "multiphase",
          "power delivery ic", "power-conversion", "vpd", "intermediate bus", "psu",
          "power shelf", "power shelves", "power supply", "power supplies")),
    Rule("component", "domain", "power", None, ("sic", "gan"), ("power", "module")),
    Rule("component", "domain", "thermal", None,
         ("heat exchanger", "cdu core", "brazed-plate")),
    Rule("component", "layer", "software_infra", "EDA / Design Tools",
         company=("synopsys", "cadence")),
    Rule("component", "layer", "compute_hardware", "Server CPU", company=("arm holdings",)),
    Rule("component", "layer", "compute_hardware", "Server Management (BMC)",
         company=("aspeed",)),
    Rule("component", "layer", "compute_hardware", "Dedicated Inference Accelerators",
         ("lpu", "rdu", "dataflow", "inference accelerator", "inference engine")),
    Rule("component", "layer", "compute_hardware", _ASIC,
         ("tpu", "trainium", "xpu", "maia", "custom ai", "custom asic", "npu", "asic")),
    Rule("component", "layer", "compute_hardware", "Server CPU",
         ("epyc", "grace", "graviton", "axion", "cobalt", "neoverse", "ampereone", "server cpu",
          "host cpu", "cpu silicon")),
    Rule("component", "layer", "compute_hardware", "Server CPU", ("cpu",), none_of=("gpu",)),
    Rule("component", "layer", "compute_hardware", "Training GPU",
         ("gpu", "instinct", "blackwell", "rubin", "cdna")),
    Rule("component", "layer", "compute_hardware", "Server CPU", ("apple silicon",),
         note="client SoC designer — no exact sector"),
    Rule("component", "layer", "foundry", _COMPOUND,
         ("wafer fab", "foundry", "logic dies", "front-end"),
         ("gan", "sic", "compound", "photonics")),
    Rule("component", "layer", "foundry", _LOGIC,
         ("wafer fab", "foundry", "logic dies", "front-end")),
    Rule("component", "layer", "interconnect", "Scale-out",
         ("tomahawk", "jericho", "switch asic", "switch silicon")),
    Rule("component", "layer", "interconnect", "Scale-up",
         ("cxl", "pcie switch", "scale-up switch", "switch solutions")),
    Rule("component", "layer", "interconnect", "Components", ("co-packaged", "cpo")),
    Rule("component", "layer", "foundry", "Silicon Photonics Foundry",
         ("transceiver", "dsp", "pam4", "laser", "eml", "cw laser", "photonic",
          "silicon photonics", "optical", "tia", "fau", "retimer", "aec", "modulator",
          "optical i/o", "light engine", "pic", "serdes", "interconnect", "connector",
          "connectivity"),
         ("foundry",)),
    Rule("component", "layer", "interconnect", "Components",
         ("transceiver", "dsp", "pam4", "laser", "eml", "cw laser", "photonic",
          "silicon photonics", "optical", "tia", "fau", "retimer", "aec", "modulator",
          "optical i/o", "light engine", "pic", "serdes", "interconnect", "connector",
          "connectivity")),
    Rule("component", "layer", "advanced_packaging", "Glass-Core Substrate",
         ("glass-core", "glass substrate", "glass core")),
    Rule("component", "layer", "advanced_packaging", "FC-BGA Substrate",
         ("abf", "fcbga", "fc-bga", "fc-csp", "substrate", "ic substrate", "hbm substrate")),
    Rule("component", "layer", "advanced_packaging", "FC-BGA Substrate",
         ("pcb", "laminate", "mlb", "boards", "copper-clad", "hdi"),
         note="high-end PCB/board"),
    Rule("component", "layer", "compute_hardware", _ASIC,
         ("asic design", "asic backend", "design services", "design service", "edt"),
         note="ASIC design house"),
    Rule("component", "layer", "compute_hardware", "(unclassified)",
         note="was component; could not classify by product"),

    Rule("raw_material", "domain", "thermal", "Immersion", ("immersion",), company=COOLING),
    Rule("raw_material", "domain", "thermal", "Coolants & Fluids", company=COOLING),
    Rule("raw_material", "domain", "thermal", "Immersion",
         ("coolant", "novec", "immersion coolant", "fluorinated"), ("immersion",)),
    Rule("raw_material", "domain", "thermal", "Coolants & Fluids",
         ("coolant", "novec", "immersion coolant", "fluorinated")),
    Rule("raw_material", "domain", "power", "Datacenter Power", ("busbar", "cold plate stock")),
    Rule("raw_material", "domain", "power", "Grid",
         ("electrical steel", "goes", "grain-oriented")),
    Rule("raw_material", "layer", "advanced_packaging", "Glass-Core Substrate",
         ("glass-core", "glass substrate", "glass panel")),
    Rule("raw_material", "layer", "interconnect", "Components",
         ("optical fiber", "fiber cable", "fiber and", "mpo fiber", "single-mode")),
    Rule("raw_material", "layer", "materials", "SOI Wafers", ("soi",)),
    Rule("raw_material", "layer", "materials", "InP Wafers", ("inp", "indium phosphide")),
    Rule("raw_material", "layer", "materials", "SiC Wafers", ("sic", "silicon carbide")),
    Rule("raw_material", "layer", "materials", "Compound Substrates", ("gan",),
         note="GaN substrate (no exact PDF sector)"),
    Rule("raw_material", "layer", "materials", "Silicon Wafers (300mm)",
         ("silicon wafer", "300mm", "polished", "prime silicon", "epitaxial silicon")),
    Rule("raw_material", "layer", "materials", "Photoresist", ("photoresist", "resist")),
    Rule("raw_material", "layer", "materials", _GASES, ("gas", "filtration", "ultra-pure")),
    Rule("raw_material", "layer", "materials", "Process Chemicals & Slurries",
         ("slurry", "etchant", "precursor", "chemical", "cmp")),
    Rule("raw_material", "layer", "materials", _ABF,
         ("abf", "bt resin", "build-up film", "buildup film", "encapsulant",
          "molding compound", "die-attach", "dielectric")),
    Rule("raw_material", "layer", "materials", _ABF, ("copper foil", "laminate")),
    Rule("raw_material", "layer", "materials", "Photomask & Targets",
         ("photomask", "mask blank", "sputtering target")),
    Rule("raw_material", "layer", "materials", "Passive Component Materials",
         ("batio3", "barium titanate", "nickel", "paste", "perovskite", "ni "),
         note="MLCC raw material"),
    Rule("raw_material", "layer", "materials", _GASES,
         note="was raw_material; unclassified"),
)

# --- Fixed values: placement of a player whose tier is not known ------------------
UNKNOWN_TIER = ("layer", "compute_hardware", "Networking ASIC")
