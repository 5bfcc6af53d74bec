"""Named, ordered lists of bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The bundles of each family, in order.
ALL = """AF_left AF_right ATR_left ATR_right CA CC_1 CC_2 CC_3 CC_4 CC_5 CC_6 CC_7 CG_left CG_right CST_left CST_right MLF_left MLF_right
FPT_left FPT_right FX_left FX_right ICP_left ICP_right IFO_left IFO_right ILF_left ILF_right MCP OR_left OR_right POPT_left POPT_right
SCP_left SCP_right SLF_I_left SLF_I_right SLF_II_left SLF_II_right SLF_III_left SLF_III_right STR_left STR_right UF_left UF_right CC
T_PREF_left T_PREF_right T_PREM_left T_PREM_right T_PREC_left T_PREC_right T_POSTC_left T_POSTC_right T_PAR_left T_PAR_right T_OCC_left T_OCC_right
ST_FO_left ST_FO_right ST_PREF_left ST_PREF_right ST_PREM_left ST_PREM_right ST_PREC_left ST_PREC_right ST_POSTC_left ST_POSTC_right
ST_PAR_left ST_PAR_right ST_OCC_left ST_OCC_right"""
PROFILES = """AF_left AF_right ATR_left ATR_right CC_1 CC_2 CC_3 CC_4 CC_5 CC_6 CC_7 CG_left CG_right CST_left CST_right FPT_left FPT_right
ICP_left ICP_right IFO_left IFO_right ILF_left ILF_right MCP OR_left OR_right POPT_left POPT_right SCP_left SCP_right SLF_I_left SLF_I_right
SLF_II_left SLF_II_right SLF_III_left SLF_III_right STR_left STR_right UF_left UF_right T_PREM_left T_PREM_right T_PAR_left T_PAR_right
T_OCC_left T_OCC_right ST_FO_left ST_FO_right ST_PREM_left ST_PREM_right"""
ELEVEN = "CST_left CST_right IFO_left IFO_right CA CG_left CG_right FX_left FX_right UF_left UF_right"
TWENTY = "AF_left AF_right CA CST_left CST_right CG_left CG_right ICP_left ICP_right MCP SCP_left SCP_right ILF_left ILF_right IFO_left IFO_right OR_left OR_right UF_left UF_right"
AUTOPTX = """af_l af_r ar_l ar_r atr_l atr_r cbd_l cbd_r cbp_l cbp_r cbt_l cbt_r cing_l cing_r cst_l cst_r fa_l fa_r fma fmi fx_l fx_r
ifo_l ifo_r ilf_l ilf_r mcp mdlf_l mdlf_r MG_ac MG_unc_l MG_unc_r or_l or_r slf1_l_kattest2_symm slf1_r_kattest2_symm slf2_l_kattest2_symm
slf2_r_kattest2_symm slf3_l_kattest2_symm slf3_r_kattest2_symm str_l str_r unc_l unc_r"""
AUTOPTX_27 = "ar_l ar_r atr_l atr_r cgc_l cgc_r cgh_l cgh_r cst_l cst_r fma fmi ifo_l ifo_r ilf_l ilf_r mcp ml_l ml_r ptr_l ptr_r slf_l slf_r str_l str_r unc_l unc_r"
XTRACT = """ac af_l af_r ar_l ar_r atr_l atr_r cbd_l cbd_r cbp_l cbp_r cbt_l cbt_r cst_l cst_r fa_l fa_r fma fmi fx_l fx_r ifo_l ifo_r
ilf_l ilf_r mcp mdlf_l mdlf_r or_l or_r slf1_l slf1_r slf2_l slf2_r slf3_l slf3_r str_l str_r uf_l uf_r vof_l vof_r"""

FAMILIES = {"all": ALL, "profiles": PROFILES, "11": ELEVEN, "20": TWENTY, "20_endpoints_combined": TWENTY, "autoptx": AUTOPTX, "autoptx_27": AUTOPTX_27, "xtract": XTRACT}


def bundle_names(family: str) -> list[str]:
    """``all`` (72), ``profiles`` (50), ``part1`` .. ``part4`` (18 each), ``11``, ``20``, ``autoptx`` (44), ``autoptx_42``, ``autoptx_27``, ``xtract`` (42).

    With ``_endpoints`` behind a name: both ends of each of its bundles; with ``_bundles_endpoints``: each bundle
    and its ends. Another name stands for itself.
    """
    if family in FAMILIES:
        return FAMILIES[family].split()
    if family.endswith("_bundles_endpoints"):
        return [f"{n}{e}" for n in bundle_names(family.removesuffix("_bundles_endpoints")) for e in ("", "_b", "_e")]
    if family.endswith("_endpoints"):
        return [f"{n}_{e}" for n in bundle_names(family.removesuffix("_endpoints")) for e in "be"]
    if family == "autoptx_42":
        return AUTOPTX.split()[:42]
    if family in ("part1", "part2", "part3", "part4"):
        k = int(family[-1]) - 1
        return ALL.split()[18 * k : 18 * k + 18]
    return [family]


def bundle_catalog(spark: SparkSession, family: str = "all") -> DataFrame:
    """``bundle, idx, family, in_profiles``; index 0 is the background."""
    own = set(bundle_names("profiles"))
    return spark.createDataFrame([(n, i, family, n in own) for i, n in enumerate(["BG", *bundle_names(family)])], "bundle string, idx int, family string, in_profiles boolean")
