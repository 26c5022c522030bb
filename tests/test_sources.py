"""Files read whole, and annotation files picked by video and event."""

import os

import pytest

from barkgraph.sources import cvat, files
from barkgraph.sources.mot import read_mot

DOCUMENT = '<?xml version="1.0"?>\n<annotations>\n<track id="{t}" label="dog">\n<box frame="2" outside="0" xtl="1" ytl="2" xbr="3" ybr="4"><attribute name="vocalization">Barking</attribute></box>\n<box frame="3" outside="1" xtl="1" ytl="2" xbr="3" ybr="4"/>\n</track>\n</annotations>\n'


def clip(root, video, name, track=1):
    folder = f"{root}/video_id={video}/clip={name}"
    os.makedirs(folder)
    with open(f"{folder}/annotations.xml", "w") as f:
        f.write(DOCUMENT.format(t=track))


def events(spark, *rows):
    return spark.createDataFrame(rows, "video_id long, event_id long, clip_start_frame long")


def test_ground_truth_of_the_events_that_are_asked_for(spark, tmp_path):
    clip(tmp_path, 1, "004_bark", 7)
    clip(tmp_path, 2, "004_bark", 8)
    clip(tmp_path, 2, "005_bark", 9)
    asked = events(spark, (1, 4, 100), (2, 5, 30), (2, 6, 10), (3, 4, 0))  # two of them nobody annotated
    got = cvat.ground_truth(spark, str(tmp_path), asked).collect()
    assert sorted((r.video_id, r.event_id, r.ident, r.frame, r.state) for r in got) == [(1, 4, "7", 102, "barking"), (2, 5, "9", 32, "barking")]
    assert cvat.ground_truth(spark, str(tmp_path), asked.where("event_id = 6")).count() == 0


def test_only_the_files_that_are_asked_for_are_picked(spark, tmp_path):
    clip(tmp_path, 1, "004_bark")
    clip(tmp_path, 1, "005_bark")
    picked = cvat.annotated_clips(spark, str(tmp_path), events(spark, (1, 5, 0), (1, 6, 0))).collect()
    assert [(r.video_id, r.event_id, r.file.rsplit("clip=", 1)[1]) for r in picked] == [(1, 5, "005_bark/annotations.xml")]


def test_two_clips_of_an_event_are_an_error(spark, tmp_path):
    clip(tmp_path, 1, "004_bark")
    clip(tmp_path, 1, "004_again")
    with pytest.raises(Exception, match="two clips for video 1, event 4"):
        cvat.ground_truth(spark, str(tmp_path), events(spark, (1, 4, 0))).count()
    assert cvat.ground_truth(spark, str(tmp_path), events(spark, (1, 5, 0))).count() == 0


def test_documents_over_several_lines(spark, tmp_path):
    (tmp_path / "l.json").write_text('\n[\n {"a": 1},\n 5,\n {"a":\n  2}\n]\n')
    assert sorted(r.a for r in files.read_json_list(spark, f"{tmp_path}/l.json", "a long").collect()) == [1, 2]
    (tmp_path / "d.json").write_text('{\n "a": 3,\n "b": "x"\n}\n')
    assert [tuple(r) for r in files.read_json_document(spark, f"{tmp_path}/d.json", "a long, b string").collect()] == [(3, "x")]


def test_mot_rows_are_numbered_within_their_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0,rex,1,2,3,4,0.5\n\n0,ada,1,2,3,4\n1\trex\t5,6,7,8,0.25,\n")
    got = sorted((r.frame, r.id, r.x, r.conf) for r in read_mot(spark, f"{tmp_path}/a.txt").collect())
    assert got == [(1, 1, 1.0, 0.5), (1, 2, 1.0, 1.0), (2, 1, 5.0, 0.25)]
