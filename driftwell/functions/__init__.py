"""Column helpers for vectors, matrices and their aggregates."""

from driftwell.functions.aggregates import axpy_array_aggregate, axpy_matrix_aggregate, latest_state_likelihood, weighted_mean_array
from driftwell.functions.matrices import (
    array_to_matrix,
    diag_matrix,
    diag_struct,
    eye_matrix,
    eye_struct,
    matrix_to_array,
    multiply_matrix,
    multiply_matrix_vector,
    multiply_struct,
    multiply_struct_array,
    outer_product,
    outer_struct,
    project_matrix,
    project_struct,
    rand_multi_gaussian,
    rand_multi_gaussian_with_col,
    scale_to_multi_gaussian,
    transpose_struct,
    zeros_matrix,
    zeros_struct,
)
from driftwell.functions.vectors import array_to_vector, axpy_array, axpy_vector, dot_array, dot_vector, ones_vector, scal_array, scal_vector, vector_to_array, zeros_vector

#: The names users of the original camel-case surface know.
arrayToVector, vectorToArray, arrayToMatrix, matrixToArray = array_to_vector, vector_to_array, array_to_matrix, matrix_to_array
zerosVector, onesVector, dotVector, scalVector, axpyVector = zeros_vector, ones_vector, dot_vector, scal_vector, axpy_vector
eyeMatrix, zerosMatrix, diagMatrix, multiplyMatrix, multiplyMatrixVector = eye_matrix, zeros_matrix, diag_matrix, multiply_matrix, multiply_matrix_vector
projectMatrix, outerProduct, scaleToMultiGaussian = project_matrix, outer_product, scale_to_multi_gaussian
randMultiGaussian, randMultiGaussianWithCol, randnMultiGaussian = rand_multi_gaussian, rand_multi_gaussian_with_col, rand_multi_gaussian
