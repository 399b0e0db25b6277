import numpy as np
import pytest

from kinegrid.functions import kernels
from kinegrid.operators import pixels, spatial

RNG = np.random.default_rng(5)


def rows(spark, image, **more):
    h, w = image.shape
    data = [("v", 0, y, x, float(image[y, x]), *(float(m[y, x]) for m in more.values())) for y in range(h) for x in range(w)]
    return spark.createDataFrame(data, "video_id string, t int, y int, x int, g double" + "".join(f", {k} double" for k in more))


def grid(df, name, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.y, r.x] = r[name]
    return out


def texture(h, w):
    return kernels.smooth(RNG.random((h, w)) * 255, 2.0) * 4


@pytest.mark.parametrize("shift", [(0, 0), (1, 0), (2, 1), (-3, 2)])
def test_flow_of_a_known_shift(shift):
    big = texture(120, 140)
    dx, dy = shift
    prev, curr = big[20:100, 20:120], big[20 - dy : 100 - dy, 20 - dx : 120 - dx]
    flow = kernels.dense_flow(prev, curr)[16:-16, 16:-16]
    assert np.abs(np.median(flow, axis=(0, 1)) - [dx, dy]).max() < 0.15


def test_downscale_is_the_mean():
    image = RNG.random((8, 12))
    assert np.allclose(kernels.area_downscale(image, 0.25), image.reshape(2, 4, 3, 4).mean(axis=(1, 3)))
    assert kernels.area_downscale(RNG.random((10, 7)), 0.25).shape == (2, 1)


def test_sobel_kernel_equals_projection(spark):
    image = RNG.integers(0, 255, (6, 7)).astype(float)
    df = pixels.gradients(rows(spark, image), 6, 7)
    ix, iy = kernels.sobel(image)
    assert np.allclose(grid(df, "ix", image.shape), ix) and np.allclose(grid(df, "iy", image.shape), iy)


def test_aperture_kernel_equals_projection(spark):
    image, flow = RNG.integers(0, 255, (9, 9)).astype(float), RNG.normal(size=(9, 9, 2))
    st = kernels.structure_tensor(image)
    df = rows(spark, image, jxx=st["jxx"], jyy=st["jyy"], jxy=st["jxy"], u=flow[..., 0], v=flow[..., 1])
    df = pixels.aperture_reliability(pixels.tangent(pixels.eigenvalues(df)))
    got = kernels.aperture_reliability(image, flow)
    assert np.allclose(grid(df, "r", image.shape), got, atol=1e-6) and got.min() >= 0 and got.max() <= 1


def test_cells_kernel_equals_projection(spark):
    flow, w = RNG.normal(size=(12, 16, 2)), RNG.random((12, 16))
    df = spatial.window_weighted_mean(rows(spark, w, u=flow[..., 0], v=flow[..., 1], w=w), 12, 16)
    got = kernels.weighted_cells(flow, w)
    assert got.shape == (3, 4, 2)
    assert np.allclose(grid(df, "u", (3, 4)), got[..., 0]) and np.allclose(grid(df, "v", (3, 4)), got[..., 1])
