"""Failures and their categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed name of the approach whose bounded fits differ.
LAJAUNIE = "Lajaunie_approach"

#: Fixed names of the categories that this engine reports.
CATEGORIES = (
    "NonFiniteInput", "ZeroNormal", "NormalZOutOfRange", "DegenerateOrientation", "InvalidInputData", "NoInterfaceData", "InterpolationMatrixFailure",
    "UnsupportedKernel", "LinearDerivativeUnavailable", "SingularSystem", "NonFiniteMatrix", "NonFiniteRightHandSide", "NonFiniteSolution", "ResidualTooLarge",
    "EqualityVectorOutOfBounds", "ModelTooLarge", "MissingInequalities", "InfeasibleSolution", "ComplementarityTolerance", "IterationLimit", "KernelLayoutMismatch",
    "UnknownModel", "UnknownRbf",
)

#: Fixed names of the public categories, in the order of their declaration.
PUBLIC_CATEGORIES = (
    "NoInterfaceData", "NoInterfaceIncrementPairs", "NoPlanarData", "InvalidInputData", "GlobalAnisotropyFailure", "AnisotropicKernelCreationFailure", "BasisFunctionSetupFailure", "ModifiedKernelCreationFailure",
    "LagrangianBasisCreationFailure", "LinearSolverFailure", "PredictorCorrectorSolverFailure", "LoqoSolverFailure", "InterpolationMatrixFailure", "EqualityVectorFailure", "InequalityVectorFailure",
    "InterfaceIsoValueUpdateFailure", "InterpolantComputationFailure", "MissingInterpolant", "UnknownRbf", "InterpolantNeedsUpdate", "UnknownModel", "SpatialParametersFailure", "IncorrectArrayDimensions",
)


def public_category(error: Column, quadratic: Column, restricted: bool = False, model: str = "") -> Column:
    """The public category of an engine's category, of a model with or without a quadratic program; null for a refusal that is the engine's
    own: a number that is not finite, a model too large, a kernel that does not fit."""
    solver = F.when(~quadratic, "LinearSolverFailure")
    # the bounded fits of Lajaunie's approach report the other solver's category
    solver = solver.when(F.lit(restricted and model != LAJAUNIE), "LoqoSolverFailure").otherwise("PredictorCorrectorSolverFailure")
    failed = error.isin("SingularSystem", "NonFiniteMatrix", "NonFiniteRightHandSide", "NonFiniteSolution", "ResidualTooLarge", "InfeasibleSolution", "ComplementarityTolerance", "IterationLimit")
    return F.when(failed, solver).when(error.isin("UnsupportedKernel"), "BasisFunctionSetupFailure").when(error.isin(*PUBLIC_CATEGORIES), error)


class FieldError(ValueError):
    """A refused input or a failed solution; category is one of CATEGORIES."""

    def __init__(self, category: str, detail: str = ""):
        super().__init__(f"{category}: {detail}" if detail else category)
        self.category = category

    def __reduce__(self):
        return FieldError, (self.category, str(self).partition(": ")[2])
