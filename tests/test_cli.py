import numpy as np
import pytest

from rasterquarry import cli
from rasterquarry.operators import images

from . import wire


def test_wrong_arguments_exit_with_two():
    for args in ([], ["a"], ["a", "b", "--max-pixels", "x"], ["a", "b", "--orientation", "z"], ["a", "b", "--none"]):
        with pytest.raises(SystemExit) as e:
            cli.parser().parse_args(args)
        assert e.value.code == 2


def test_failures_are_told_by_category():
    assert cli.failure("UnsupportedFeature: item type hvc1") == "Decode failed [category=UnsupportedFeature]: item type hvc1"
    assert cli.failure("missing pitm") == "Decode failed [category=MalformedInput]: missing pitm"
    assert cli.failure("ResourceLimit") == "Decode failed [category=ResourceLimit]: ResourceLimit"


def test_a_file_to_png(spark, tmp_path, capsys):
    (tmp_path / "a.heif").write_bytes(wire.container(exif=wire.tiff(6)))
    assert cli.main([str(tmp_path / "a.heif"), str(tmp_path / "a.png")]) == 0
    data = (tmp_path / "a.png").read_bytes()
    assert data[16:24] == (1).to_bytes(4, "big") + (2).to_bytes(4, "big")
    assert cli.main([str(tmp_path / "a.heif"), str(tmp_path / "b.png"), "--max-pixels", "1"]) == 1
    assert cli.main([str(tmp_path / "a.heif"), str(tmp_path / "b.png"), "--max-input-bytes", "5"]) == 1
    assert "category=ResourceLimit" in capsys.readouterr().err


def test_orientations_agree_with_where_pixels_go():
    image = np.arange(6 * 4, dtype=np.uint8).reshape(2, 3, 4)
    h, w = 2, 3
    for k in range(0, 10):
        to = {2: lambda x, y: (w - 1 - x, y), 3: lambda x, y: (w - 1 - x, h - 1 - y), 4: lambda x, y: (x, h - 1 - y), 5: lambda x, y: (y, x), 6: lambda x, y: (h - 1 - y, x), 7: lambda x, y: (h - 1 - y, w - 1 - x), 8: lambda x, y: (y, w - 1 - x)}.get(k, lambda x, y: (x, y))
        out = images.upright(image, k)
        for y in range(h):
            for x in range(w):
                a, b = to(x, y)
                assert (out[b, a] == image[y, x]).all()
