"""Factor names by family. Names and pairings are part of the published feature set."""

# fixed values: model set of base factors
BASE = """
t_imb t_imb_w30 t_imb_w10 t_imb_2s t_imb_5s t_size_imb
ofi ofi_w30 ofi_w10 ofi_norm ofi_w30_norm ofi_w10_norm ofi_5s
book_imb0 book_imb60 d_book_imb spread0 spread_mean60
d60_mid d600_mid d60_micro mid_vol60 mid_vol600 sig_txn
t_n t_vol o_n o_vol
imp_depth_60 imp_depth_5 aggr_imb spread_cross_frac cancel_imb patience_diff
range_pos curv vwap_dev60 vwap_dev600 vol_skew last_gap burst5 accel
spread_sqz depth_flow vol_ratio micro_imb0 micro_imb60
""".split()

# fixed values: first extension (t_vol_nf_15 is computed but not part of the list)
EXT1 = """
rel_spread2_0 imb2_0 slope_0 ask_slope_mean60 bid_slope_mean60 slope_imb60
m_rv60 m_rv600 x_rv_60_600
t_has_data_15 t_miss_max o_has_data_15 o_miss_max
t_price_nf_15 t_price_nf_30 t_price_nf_60 t_vol_nf_30 t_vol_nf_60
t_rc_nf_15 t_rc_nf_30 t_rc_nf_60
o_vol_nf_15 o_vol_nf_30 o_vol_nf_60 o_rc_nf_15 o_rc_nf_30 o_rc_nf_60
o_cancel_nf_15 o_cancel_nf_30 o_cancel_nf_60
x_to_buy_diff x_to_buy_diff_15 t_large_buy t_large_sell x_large_imb
""".split()
EXT1_HELPERS = "t_vol_nf_15 t_buy_ratio t_buy_ratio_15 o_buy_ratio o_buy_ratio_15 t_n_15".split()

# fixed values: second extension
EXT2 = """
m_mid_last m_mid_mean m_mid_std m_mid_skew m_sp_mean m_sp_std
m_imb_mean m_imb_std m_imb2_mean60 m_dofi m_dofi_60
m_dofi_ewm120 m_mid_ewm30 m_mid_ewm120 m_imb_ewm30 m_imb_ewm120
x_imb_ewm_sl x_dofi_ewm_sl x_mid_zscore
t_sd t_sd_15 t_sd_45 t_px_std t_px_skew t_px_last t_lv_mean
t_gap_mean t_gap_std t_gap_max t_gap_cv
t_firsthalf_price t_firsthalf_buyratio t_firstthird_vol t_firstlast_px
x_t_signed_ratio x_t_signed_w15_diff
t_pxdiff1_mean t_pxdiff1_std t_pxdiff7_mean t_pxdiff7_std t_voldiff1_mean t_voldiff7_mean
t_vwap t_autocorr_lag1 t_autocorr_lag5
o_px_std o_px_skew o_bid_depth o_ask_depth o_sv o_av
o_gap_mean o_gap_std o_gap_cv o_cancel_new_ratio o_firsthalf_price o_firstthird_vol
o_pxdiff1_mean o_pxdiff1_std o_pxdiff7_std o_voldiff1_mean
x_sp_imb x_vwap_mid_ratio x_trans_order_vol_ratio
""".split()

# fixed values: third extension
EXT3 = """
m_dofi2_sum60 m_dofi2_ewm120 m_imb_med m_imb_q25 m_sp_q75 m_mid_ret_abs_mean60
m_mid_slope_180 m_mid_slope_60 m_imb_mean_15 x_imb_15_180 m_txv_std30
m_ask_gap_mean60 m_bid_gap_mean60
t_sv_5 t_sv_60 x_t_sv_5_60 t_vol_5 x_t_vol_5_60 t_n_60 x_tn_15_60 t_sd_ewm45
t_vol_max30 o_vol_max30 t_buy_sell_vol_ratio
t_large_buy_15 t_large_sell_15 x_large_imb_15
t_pxdiff14_mean t_pxdiff14_std t_pxdiff21_std t_pxdiff30_std t_voldiff14_mean t_voldiff21_mean
o_sv_ewm15 o_av_ewm45 o_add_ratio o_pxdiff14_std o_voldiff14_mean
""".split()

# fixed values: product pairs
PAIRS = [
    ("t_imb_w10", "m_mid_std"),
    ("t_imb_w10", "m_rv600"),
    ("ofi_w10", "m_mid_std"),
    ("ofi_w10", "m_dofi_ewm120"),
    ("t_sd_15", "m_rv600"),
    ("m_imb_mean", "m_rv600"),
    ("x_to_buy_diff_15", "t_vol"),
    ("m_mid_std", "t_n"),
    ("d_book_imb", "m_rv60"),
    ("m_dofi_ewm120", "m_sp_std"),
    ("t_imb_2s", "m_imb_mean"),
    ("m_mid_std", "m_sp_mean"),
]
PAIR_NAMES = [f"xp_{a}__{b}" for a, b in PAIRS]

# fixed values: helper outputs kept beside the base factors
BASE_HELPERS = "mid micro mid60 micro60 mid600".split()

ALL = [*BASE, *EXT1, *EXT2, *EXT3, *PAIR_NAMES]

# fixed values: how a factor is brought to a common unit before a tabular model
TICK = """
spread0 spread_mean60 d60_mid d600_mid d60_micro mid_vol60 mid_vol600 sig_txn curv
vwap_dev60 vwap_dev600 micro_imb0 micro_imb60
ask_slope_mean60 bid_slope_mean60 slope_imb60 m_rv60 m_rv600
m_mid_std m_sp_mean m_sp_std t_px_std t_firstlast_px
t_pxdiff1_mean t_pxdiff1_std t_pxdiff7_mean t_pxdiff7_std
o_px_std o_pxdiff1_mean o_pxdiff1_std o_pxdiff7_std
t_pxdiff14_mean t_pxdiff14_std t_pxdiff21_std t_pxdiff30_std o_pxdiff14_std
m_sp_q75 m_mid_ret_abs_mean60 m_mid_slope_180 m_mid_slope_60 m_ask_gap_mean60 m_bid_gap_mean60
""".split()
TICK_ASINH = "t_sd t_sd_15 t_sd_45 t_sd_ewm45".split()
ASINH = """
ofi ofi_w30 ofi_w10 ofi_5s t_n t_vol o_n o_vol last_gap
t_has_data_15 t_miss_max o_has_data_15 o_miss_max t_large_buy t_large_sell
m_dofi m_dofi_60 m_dofi_ewm120 x_dofi_ewm_sl
t_gap_mean t_gap_std t_gap_max t_firstthird_vol t_voldiff1_mean t_voldiff7_mean
o_bid_depth o_ask_depth o_sv o_av o_gap_mean o_gap_std o_firstthird_vol o_voldiff1_mean
m_dofi2_sum60 m_dofi2_ewm120 m_txv_std30 t_sv_5 t_sv_60 t_vol_5 t_n_60 t_vol_max30
t_voldiff14_mean t_voldiff21_mean o_voldiff14_mean t_large_buy_15 t_large_sell_15
o_sv_ewm15 o_av_ewm45 o_vol_max30
""".split() + PAIR_NAMES
RAW = [f for f in ALL if f not in {*TICK, *TICK_ASINH, *ASINH}]


def unit_classes_of(columns):
    """The unit class of each wanted column; the four classes must cover all factors exactly once."""
    classes = {"tick": TICK, "tick_asinh": TICK_ASINH, "asinh": ASINH, "raw": RAW}
    if sorted(c for cols in classes.values() for c in cols) != sorted(ALL):
        raise ValueError("unit classes do not partition the factors")
    return {kind: [c for c in cols if c in set(columns)] for kind, cols in classes.items()}
