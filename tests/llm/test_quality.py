"""Problem 2: what the distributions of function words and character classes add to the structure, and texts of another family."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from vaksetu.llm import quality

# Recipes, manuals, minutes, travel and letters, in languages and layouts that the tables do not have.
OTHER = {
    "prose": [
        "Heat the oil in a wide pan and add the onions. When they are soft, put in the tomatoes with a little salt and let it cook for ten minutes. It is ready when the oil comes to the top.",
        "My dear Anna, it has been a long time since we had a letter from you. The children are well and they ask about you all the time. We hope that you will come to see us in the summer.",
        "La machine ne doit pas être ouverte par une personne qui ne connaît pas les règles. Il est dans la nature de ce travail que les outils sont lourds et que le bruit est fort.",
        "Der Ausschuss hat sich mit dem Antrag befasst und ihn nicht angenommen. Die Sitzung wird im Mai fortgesetzt, wenn auch die anderen Mitglieder im Haus sind.",
        "पहले कड़ाही में तेल गरम कीजिए और उसमें जीरा डालिए। जब प्याज़ लाल हो जाए तो टमाटर और नमक मिला दीजिए। इसे दस मिनट तक ढककर पकने दीजिए और फिर हरा धनिया डालकर परोसिए।",
        "प्रिय मित्र, तुम्हारा पत्र मिला और पढ़कर बहुत अच्छा लगा। यहाँ सब ठीक है और माँ भी अब पहले से अच्छी हैं। इस बार की छुट्टियों में हम सब तुम्हारे शहर आने की सोच रहे हैं।",
        "सकाळी लवकर उठून आम्ही गडावर गेलो आणि तेथून समुद्र पाहिला. पाऊस नव्हता पण वारा जोरात होता. दुपारी आम्ही खाली आलो आणि गावात जेवण केले.",
        "সকালে উঠে আমরা নদীর ধারে গেলাম এবং সেখানে নৌকা দেখলাম। বৃষ্টি ছিল না কিন্তু বাতাস ছিল জোরে। পরে আমরা গ্রামে ফিরে এসে খাবার খেলাম।",
        "میں صبح سویرے اٹھ کر باغ میں گیا اور وہاں کے پھول دیکھے۔ بارش نہیں تھی لیکن ہوا تیز تھی۔ دوپہر کے بعد ہم گھر واپس آئے اور سب کے ساتھ کھانا کھایا۔",
        "我们早上很早就起来，然后到河边去看船。那天没有下雨，但是风很大。中午我们回到村里，在朋友的家里吃了饭，又说了很多以前的事。",
        "朝早く起きて、みんなで川へ行きました。雨は降っていませんでしたが、風がとても強かったです。昼になると村に戻って、友だちの家でごはんを食べました。",
        "Turn the key to the left and hold it there until the light is green. If the light stays red, the battery is not in the right place. Do not use force on the cover, as it can break.",
    ],
    "list": [
        "flour\nsugar\nbutter\neggs\nbaking powder\nsalt\nvanilla\nmilk", "- flour - brown sugar - cold butter - two eggs - baking powder - sea salt - vanilla pods - whole milk", "1. passport\n2. tickets\n3. phone charger\n4. rain coat\n5. sun cream\n6. first aid kit",
        "• Paris • Lyon • Marseille • Toulouse • Nice • Nantes • Bordeaux • Lille", "आटा\nचीनी\nघी\nइलायची\nकाजू\nकिशमिश\nदूध", "- गेहूँ का आटा - देसी घी - पिसी चीनी - हरी इलायची - कटे काजू - भुनी सूजी - ठंडा दूध - केसर धागे", "१. छाता\n२. टॉर्च\n३. कंबल\n४. पानी बोतल\n५. दवाइयाँ\n६. रस्सी", "दाल; चावल; नमक; हल्दी; जीरा; धनिया; मिर्च; तेल",
    ],
    "table": [
        "city|area|people\nParis|105|2102650\nLyon|48|522250\nNice|72|348085\nLille|35|236710", "date\tkm\tmin\n01.05.\t12\t61\n03.05.\t8\t40\n06.05.\t15\t80\n09.05.\t10\t52", "name,height,weight\nAsha,152,48\nRavi,170,66\nMeena,160,55\nJohn,181,79\nSara,165,58",
        "सामान | मात्रा | दाम\nआटा | 5 किलो | 210\nचीनी | 2 किलो | 90\nतेल | 1 लीटर | 165\nदाल | 3 किलो | 330",
    ],
    "junk": ["Home\nLogin\nCart\nHome\nSearch\nLogin\nMenu\nShare\nCart", "function init(){var a=[];for(i=0;i<9;i++){a[i]=x(i);}return{a:a};}", "4711 8841 9932 1203 5541\n8842 1190 7741 2203\n5512 9981 3341", "xK9fQ2mL8vZ3 pT7wR4yB1nC6 aJ5sD0gH2eU8 qW3zX7cV1bN4", "click here click here click here click here click here click here click here"],
}


def structure_only(monkeypatch):
    monkeypatch.setattr(quality, "W_STRUCTURE", 1.0)
    monkeypatch.setattr(quality, "W_FUNCTION", 1e-9)
    monkeypatch.setattr(quality, "W_CLASS", 1e-9)
    monkeypatch.setattr(quality.Profiles, "prose_share", lambda self, shapes: np.ones(len(shapes)))


def right(profiles, analyser):
    return {(kind, n): quality.nearest(analyser.analyse(text)[1], profiles)[0] == kind for kind, texts in OTHER.items() for n, text in enumerate(texts)}


def test_texts_of_another_family(monkeypatch):
    """Built-in profiles alone, no labels: the share of right kinds, and what is lost without the distributions."""
    analyser = quality.Analyser(set())
    full = right(quality.fit([]), analyser)
    structure_only(monkeypatch)
    bare = right(quality.fit([]), analyser)
    print(sum(full.values()), sum(bare.values()), len(full), [k for k, ok in full.items() if not ok], [k for k, ok in bare.items() if not ok])
    assert sum(full.values()) >= 0.9 * len(full) and sum(full.values()) > sum(bare.values())


def test_distributions_decide_rows_of_the_table(small, monkeypatch):
    """Inline lists of sf0.1 that the structure takes for sentences: their function words are not those of prose."""
    up = Path(small).parent / "sf0.1"
    labels = duckdb.execute(f"SELECT l.kind, p.text FROM '{up}/processed.parquet' p JOIN '{up}/quality_labels.parquet' l USING (row_id) WHERE l.kind IS NOT NULL").fetchall()
    texts = [t for (t,) in duckdb.execute(f"SELECT text FROM '{up}/processed.parquet' WHERE starts_with(text, '- ') AND NOT contains(text, chr(10))").fetchall()]
    analyser = quality.Analyser(set())
    shapes = [(k, analyser.analyse(t)[1]) for k, t in labels]
    asked = [analyser.analyse(t)[1] for t in texts]
    full = [k for k, _ in quality.fit(shapes).nearest(asked)]
    structure_only(monkeypatch)
    bare = [k for k, _ in quality.fit(shapes).nearest(asked)]
    print(len(texts), full.count("list"), bare.count("list"))
    assert full.count("list") > bare.count("list") and set(full) == {"list"}


@pytest.mark.parametrize("lang, text", [("hi", OTHER["prose"][4]), ("mr", OTHER["prose"][6]), ("bn", OTHER["prose"][7]), ("ur", OTHER["prose"][8]), ("zh", OTHER["prose"][9]), ("ja", OTHER["prose"][10]), ("fr", OTHER["prose"][2])])
def test_language_profile(lang, text):
    """Prose is nearer to the prose of its language than to loose words of it; the same words without the function words are not."""
    analyser, profiles = quality.Analyser(set()), quality.fit([])
    shape = analyser.analyse(text)[1]
    assert shape.lang == lang and profiles.prose_share([shape])[0] > 0.5
    loose = shape._replace(function=np.append(np.zeros(quality.TOP + 1), 1.0), words=100.0)
    assert profiles.prose_share([loose])[0] < 0.3


def test_labels_change_the_profile_of_their_language_only():
    analyser = quality.Analyser(set())
    shape = analyser.analyse(OTHER["prose"][4])[1]
    profiles = quality.fit([("prose", shape)] * 50)
    assert np.abs(profiles.of("hi")[0] - shape.function).max() < 0.02 and (profiles.of("fr")[0] == quality.PROSE_FUNCTION).all()
