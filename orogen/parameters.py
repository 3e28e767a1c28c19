"""Parameters of a fit."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import LAJAUNIE, FieldError
from .functions.kernels import CUBIC, KERNELS

SINGLE_SURFACE, STRATIGRAPHIC, CONTINUOUS, VECTOR = "Single_surface", "Stratigraphic_horizons", "Continuous_property", "Vector_field"
#: Fixed codes of the models.
MODEL_CODES = {1: SINGLE_SURFACE, 2: LAJAUNIE, 3: VECTOR, 4: STRATIGRAPHIC, 5: CONTINUOUS}


@dataclass(frozen=True)
class Parameters:
    model: str = SINGLE_SURFACE
    kernel: str = CUBIC
    shape: float = 100.0
    polynomial_order: int = 1
    smoothing: float | None = None
    anisotropy: bool = False
    least_thickness: float = 0.0
    #: With restricted, interfaces and orientations are bounds of these uncertainties (degrees for the angle).
    restricted: bool = False
    interface_uncertainty: float = 0.0
    angular_uncertainty: float = 0.0

    def checked(self) -> Parameters:
        if self.kernel not in KERNELS:
            raise FieldError("UnsupportedKernel", self.kernel)
        if self.model not in MODEL_CODES.values():
            raise FieldError("InvalidInputData", self.model)
        for v in (self.shape, self.smoothing or 0.0, self.least_thickness, self.interface_uncertainty, self.angular_uncertainty):
            if not abs(v) < float("inf"):
                raise FieldError("NonFiniteInput")
        if self.polynomial_order not in (0, 1, 2):
            raise FieldError("InterpolationMatrixFailure", f"polynomial order {self.polynomial_order}")
        return self

    @staticmethod
    def parsed(model: int | str, kernel: str = CUBIC, **more) -> Parameters:
        """From a model's code (1 to 5) or name and a kernel's name, spelled exactly; UnknownModel and UnknownRbf otherwise."""
        name = MODEL_CODES.get(model, model)
        if name not in MODEL_CODES.values():
            raise FieldError("UnknownModel", str(model))
        if kernel not in KERNELS:
            raise FieldError("UnknownRbf", kernel)
        return Parameters(name, kernel, **more).checked()
