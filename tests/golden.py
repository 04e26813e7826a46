"""Published fixture values (fixed values)."""

METRICS = ["bleu4", "chrfpp", "meteor", "rouge_l", "bertscore", "comet", "xcomet", "bleurt"]
# passage, condition, rating, composite divergence, source characters, reference words, 8 metrics, length-adjusted composite
PASSAGES = [
    (1, "assisted", 3, 4.58333333, 21, 42, 0.39416778, 0.67000473, 0.72612562, 0.75609756, 0.95959187, 0.79104829, 0.76147652, 0.75121814, -0.18130321),
    (2, "single", 4, 3.19444444, 18, 28, 0.74399172, 0.85887875, 0.92688081, 0.92857143, 0.97269934, 0.79052633, 0.70224017, 0.77301627, -0.85384656),
    (3, "assisted", 4, 2.08333333, 32, 54, 0.77303258, 0.79325671, 0.87307468, 0.8952381, 0.98202986, 0.80365795, 0.83008099, 0.85789257, -0.70555036),
    (4, "assisted", 8, 10.0, 23, 37, 0.0922335, 0.36568917, 0.46256702, 0.41558442, 0.87774163, 0.61286026, 0.32307988, 0.48247212, 1.90657072),
    (5, "single", 8, 5.83333333, 43, 68, 0.40810188, 0.58266284, 0.68032891, 0.6969697, 0.96343672, 0.75490344, 0.66292197, 0.74931836, 0.45536157),
    (6, "assisted", 9, 7.63888889, 16, 33, 0.34077853, 0.56512249, 0.63266871, 0.64516129, 0.92171329, 0.7482537, 0.52912426, 0.68694466, 0.38497963),
    (7, "single", 5, 8.47222222, 22, 35, 0.17698322, 0.50457695, 0.63181142, 0.67567568, 0.90647876, 0.70618576, 0.42858636, 0.58565301, 0.96753499),
    (8, "assisted", 5, 1.66666667, 21, 34, 0.78959591, 0.89069976, 0.92807393, 0.94285714, 0.98601329, 0.85371596, 0.67052907, 0.79967672, -0.99475343),
    (9, "single", 2, 6.11111111, 17, 32, 0.39941361, 0.6030254, 0.62044025, 0.61290323, 0.93737531, 0.77765357, 0.69458419, 0.77568841, 0.06162887),
    (10, "single", 3, 0.41666667, 27, 39, 0.83346766, 0.90388672, 0.9484651, 0.94871795, 0.99082768, 0.82646459, 0.81726509, 0.84308535, -1.04062222),
]
# rating, source words, divergence
RATER_A = [
    (7, 47, 0.6393522620201111), (5, 74, 0.586676836013794), (6, 13, 0.13144433498382568), (6, 49, 0.7864499539136887),
    (6, 17, 0.09405243396759033), (6, 36, 0.6876704692840576), (5, 14, 0.36469316482543945), (7, 35, 0.6046292781829834),
    (7, 194, 0.8160799890756607), (9, 90, 0.5935198664665222), (7, 16, 0.2701069116592407), (7, 8, 0.14320838451385498),
    (6, 8, 0.25853705406188965), (6, 33, 0.47472870349884033), (5, 20, 0.2638057470321655), (6, 14, 0.14527714252471924),
    (7, 18, 0.6190541386604309), (7, 47, 0.3912162780761719), (7, 56, 0.8759060725569725),
]
RATER_B = [
    (6, 47, 0.6393522620201111), (7, 74, 0.586676836013794), (3, 17, 0.24190247058868408), (2, 14, 0.36469316482543945),
    (6, 35, 0.6046292781829834), (7, 194, 0.8160799890756607), (5, 16, 0.2701069116592407), (4, 20, 0.2638057470321655),
    (2, 14, 0.14527714252471924), (7, 18, 0.6190541386604309),
]
LATENCIES = [
    15.76, 14.206, 17.414, 14.758, 6.935, 9.595, 11.734, 22.566, 22.614, 12.643, 7.488, 5.192, 17.41, 16.682, 9.226,
    9.51, 12.256, 10.488, 8.22, 16.982, 18.517, 56.855, 68.586, 351.209, 40.6, 16.397, 14.374, 26.99, 15.627,
]
RELEASES = {
    1: [("2024-04-09", 0.4302629), ("2024-05-13", 0.45588735), ("2024-08-06", 0.44594288), ("2024-11-20", 0.43667083),
        ("2025-04-14", 0.46584574), ("2025-08-07", 0.48662716), ("2025-11-13", 0.47957325), ("2025-12-11", 0.48627005),
        ("2026-03-03", 0.49122629), ("2026-03-05", 0.48370266), ("2026-04-23", 0.48311722), ("2026-07-09", 0.47173755)],
    3: [("2024-04-09", 0.58878717), ("2024-05-13", 0.63838699), ("2024-08-06", 0.64428664), ("2024-11-20", 0.64255736),
        ("2025-04-14", 0.65823784), ("2025-08-07", 0.69694084), ("2025-11-13", 0.67571372), ("2025-12-11", 0.67682905),
        ("2026-03-03", 0.68109871), ("2026-03-05", 0.71536812), ("2026-04-23", 0.74192502), ("2026-07-09", 0.72929912)],
}
SCORES = ["bleu4", "chrfpp", "meteor", "rouge_l", "unigram_f1", "trigram_f1", "char_trigram_f1", "word_edit_similarity"]
# passage, 8 scores, candidate text, reference text
TEXT_PAIRS = [
    (1, 0.39416778, 0.67000473, 0.72612562, 0.75609756, 0.75609756, 0.41025641, 0.70163934, 0.69047619,
     "The heart-mind is the center: it dwells in the midst of the body and rules it as lord; the four—eyes, ears, mouth, and heels/feet—serve as its ministers. This heart-mind is what is called the center.",
     "The heart-mind is the centre; it occupies in the centre of the body so as to rule it (ie., the body); the four—eyes, ears, mouth, and heels—serve as its ministers. The heart-mind is what is called the centre."),
    (2, 0.74399172, 0.85887875, 0.92688081, 0.92857143, 0.92857143, 0.69230769, 0.85950413, 0.89285714,
     "What the mind does, whether good or evil, returns/reproaches like a shadow; what the mind sends forth, whether small or great, follows the call like an echo.",
     "What the heart-mind does, whether good or evil, returns like a shadow; what the mind sends forth, whether small or great, follows the command like an echo."),
    (3, 0.77303258, 0.79325671, 0.87307468, 0.8952381, 0.8952381, 0.67326733, 0.79901961, 0.87037037,
     "When the mind wishes to see it, the eyes therefore look at it; when the mind wishes to hear it, the ears therefore listen to it; when the mind wishes to speak of it, the mouth therefore says it; when the mind wishes to use it, the heel therefore lifts it.",
     "When the heart-mind desires to see it, the eyes therefore look at it; when the mind desire to hear it, the ears therefore listen to it; when the heart-mind desires to speak of it, the mouth therefore says it; when the heart-mind desires to use it, the heel therefore lifts it."),
    (4, 0.0922335, 0.36568917, 0.46256702, 0.41558442, 0.51948052, 0.08219178, 0.34437086, 0.275,
     "Keep the mind still, with nothing to which it goes. Of the hundred bodily parts and the four forms, none is not [affected / responsive]. Let one who is a ruler take this as his mirror, and so rule the people.",
     "When the heart-mind is calm, none of the hundred bodies’ four ministers (ie., eyes, ears, mouth, and heels) is not (still). One who is the ruler should observe that so that he can rule the people."),
    (5, 0.40810188, 0.58266284, 0.68032891, 0.6969697, 0.63636364, 0.3125, 0.59550562, 0.61764706,
     "When people undertake something yet do not know its outcome, is it not simply that they plan but do not take measure? If they plan but do not take measure, then they have no means to know what is short and what is long. Not knowing short and long, they act rashly, striking crosswise and colliding; if they achieve success, it is called luck.",
     "When one does something and yet does not know its result, is it not simply that he plans but does not take measure? If he plans but does not take measure, then he has no way to know what is short and what is long. Not knowing short and long, he acts rashly, making crossings-and-collisions. If he was successful, it would be what is named luck."),
    (6, 0.34077853, 0.56512249, 0.63266871, 0.64516129, 0.67741935, 0.31034483, 0.58237548, 0.45454545,
     "Good fortune is Heaven; knowing the outcome of an affair is the mind. Only when mind and Heaven are both present does the affair thereby truly come to completion.",
     "Luck is (due to) Heaven; knowing the outcome of an affair is (because of) the heart-mind. It must be with both heart-mind and Heaven can the affair truly come to completion."),
    (7, 0.17698322, 0.50457695, 0.63181142, 0.67567568, 0.56756757, 0.05714286, 0.55151515, 0.41025641,
     "Calm the mind and deliberate on it; examine it, measure it, and take it as a mirror. In hearing and questioning, in looking and listening, amid the gathered “herd” of what is good, the mind there acts for it.",
     "The tranquil heart-mind deliberates on it, examines it, measures it, and reflects on it. In hearing, questioning, looking and listening, lies within the gathered goodness (for which) the heart-mind thereby acts for it."),
    (8, 0.78959591, 0.89069976, 0.92807393, 0.94285714, 0.88571429, 0.78787879, 0.87697161, 0.86111111,
     "The determining of life-allotment lies with Heaven; harsh illnesses lie with ghosts; the taking of life lies with human beings. A person has a Heaven-given allotment; he also has a bodily allotment of life.",
     "The determining of life-allotment lies with Heaven; severe illness lies with ghosts; the taking of life lies with human beings. A person has a Heaven-given allotment; he also has a bodily life."),
    (9, 0.39941361, 0.6030254, 0.62044025, 0.61290323, 0.61290323, 0.37931034, 0.59919028, 0.59375,
     "The heart-mind: through it one dies; the heart-mind: through it one lives. Death and life rest with Heaven, yet perhaps the fault also lies in the heart-mind.",
     "The heart-mind is what leads to death, the heart-mind is what leads to life.  Death and life rest with Heaven, yet perhaps their failure, too lies in the heart-mind."),
    (10, 0.83346766, 0.90388672, 0.9484651, 0.94871795, 0.94871795, 0.86486486, 0.93557423, 0.94871795,
     "Let rulers, dukes, marquises, kings, commoners, and ordinary people not pray only to spirits and Heaven for the preservation of their households to the end of their lives; let them also seek it from their [mind/heart] and body.",
     "Let rulers, dukes, marquises, kings, commoners, and ordinary people not pray merely to ghosts and Heaven for the preservation of their households to the end of their lives. Let them also seek it from their [mind/heart] and body."),
]
