"""Published results used as fixed expected values, keyed in by hand; classes by index."""

# non-zero cells (true, predicted, count) of a 38-class confusion matrix over 10,709 rows
CELLS = [
    (0, 0, 126), (0, 30, 1), (1, 1, 142), (1, 3, 1), (1, 27, 1), (1, 30, 2), (2, 2, 52), (3, 1, 1), (3, 3, 283),
    (3, 6, 1), (3, 15, 1), (4, 4, 324), (5, 5, 218), (5, 30, 1), (6, 6, 123), (7, 7, 102), (7, 9, 5), (8, 8, 215),
    (8, 9, 2), (9, 7, 7), (9, 9, 211), (9, 10, 1), (9, 30, 1), (10, 10, 250), (11, 11, 168), (12, 12, 284),
    (13, 13, 204), (14, 14, 100), (15, 15, 980), (16, 3, 1), (16, 16, 540), (16, 30, 1), (17, 3, 1), (17, 17, 70),
    (18, 15, 2), (18, 18, 164), (19, 19, 282), (19, 29, 1), (20, 20, 164), (21, 21, 205), (21, 30, 7), (22, 22, 31),
    (22, 24, 1), (23, 6, 1), (23, 23, 161), (24, 10, 1), (24, 24, 972), (25, 25, 378), (26, 26, 199), (26, 29, 1),
    (27, 27, 80), (28, 28, 435), (28, 32, 1), (29, 0, 1), (29, 28, 1), (29, 29, 196), (29, 30, 11), (29, 32, 2),
    (29, 34, 4), (30, 30, 375), (31, 31, 172), (32, 18, 4), (32, 24, 1), (32, 30, 17), (32, 32, 315), (33, 33, 318),
    (33, 34, 2), (34, 0, 1), (34, 19, 1), (34, 24, 1), (34, 30, 1), (34, 32, 3), (34, 33, 1), (34, 34, 277),
    (34, 37, 3), (35, 28, 3), (35, 35, 1097), (36, 31, 1), (36, 32, 2), (36, 33, 2), (36, 34, 1), (36, 36, 60),
    (37, 37, 330),
]
QUALITY = {
    "accuracy": 0.9901017835,
    "macro_precision": 0.9896664535,
    "macro_recall": 0.9854990582,
    "macro_f1": 0.9873730688,
    "weighted_f1": 0.9901140983,
}
ERRORS = 106

# (bin, count, gap) of 15 calibration bins; an empty bin has no gap
BINS = [
    (0, 0, None), (1, 0, None), (2, 0, None), (3, 0, None), (4, 2, 0.6717676520347595), (5, 3, 0.02598468462626141),
    (6, 3, 0.25110555688540137), (7, 19, 0.0744379194159257), (8, 19, 0.04171862100300039), (9, 25, 0.20613172292709347),
    (10, 30, 0.12768518527348838), (11, 47, 0.13235644837643235), (12, 46, 0.0488118451574574),
    (13, 98, 0.026612042164316008), (14, 10417, 0.001606991049125761),
]
ECE = 0.0038453388

SEED_ACCURACY = [0.9901017835, 0.9876739191, 0.9922495098]
SEED_MEAN, SEED_STD = 0.9900084041, 0.0022892241

# (epoch, validation loss, validation macro-F1) of two full runs and the epoch each of them kept
LONG_RUN = [
    (1, 2.406936498065899, 0.3121187191777281), (2, 1.9869210256836471, 0.4478296703869267),
    (3, 1.4768216485257086, 0.4953176848295919), (4, 1.444516190902963, 0.5822290658853396),
    (5, 0.9733433777236588, 0.6531344164713907), (6, 1.612169058590743, 0.5324791072523567),
    (7, 0.9217476462571441, 0.6936507959366445), (8, 0.8678500010163744, 0.7210063157396029),
    (9, 1.513041253555326, 0.6012652085909744), (10, 0.7228621103267424, 0.7331144373912827),
    (11, 0.9271754178772534, 0.6800345233484477), (12, 0.7165621862666164, 0.7358342716916627),
    (13, 0.8148777192029725, 0.7283197957659974), (14, 0.7386524276838777, 0.7391339856401894),
    (15, 0.4574504006523673, 0.8121116229314201),
]
SHORT_RUN = [
    (1, 0.09512365274062692, 0.9556778876019548), (2, 0.08269336280682249, 0.9563171822287605),
    (3, 0.04559024218229738, 0.9788877719145307), (4, 0.04730261651864258, 0.982591811948973),
    (5, 0.033569984300092934, 0.9840894505975214), (6, 0.023948583923088143, 0.9914232338785292),
    (7, 0.045749238248645206, 0.9804650569656508), (8, 0.03741023391221511, 0.9838450649319476),
    (9, 0.03580420852585612, 0.9863070608726625), (10, 0.016095694762519108, 0.992400127647073),
    (11, 0.017163004774367007, 0.9906157868632139), (12, 0.02086570074114585, 0.9907279447922114),
]
LONG_BEST, SHORT_BEST = 15, 10

# bootstrap accuracy interval over the cells above; equal up to Monte-Carlo error
ACCURACY_CI = (0.988141, 0.991969)
