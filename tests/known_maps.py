"""SHA-256 of the little-endian values of maps in row order, with default parameters, by seed and side. Fixed values."""

#: Height, roughness and vegetation noise, slope, aspect (32-bit floats) and landform (bytes).
TOPOGRAPHY = {
    (1, 16): {
        "h": "376b53b1df26e7cbaa962cb18189bfd22f827384f9436ba750adeace12589a12",
        "r": "5b6f56fb82b5ff6b43eb39ed848f22ba96519747f1f6c0e8a177f47aecb9a019",
        "v": "1ae78fa6c2dafc89b7a552e714bec5ca492c7341f3228fdb1faf8406e7b56c22",
        "slope": "1af1a76922e7d60c0706dc9e80470f7109bfbc5948290c1deb31c7be58899053",
        "aspect": "e1a11a86d7948a09d534863a1ee440b78d9a13575ba08f4d3d6b5d0b45496d3b",
        "landform": "f8d8ee905af31f787b0544ff843efa7461db7540c253909bc27c54b9587d56e0",
    },
    (1, 64): {
        "h": "71dec9d687a5ff14db8881344c906b86fac4f7d08c079abcaf7d657aeeae1fb7",
        "r": "2785269613233004d938cc6a4fcc0d98822443ceaaf48a9488fc3d1ef2210fa9",
        "v": "9702902fb61f561bbacb5745891f505780d5a1501488e74ab7612e88b1df19a9",
        "slope": "3b95b4479fad3bacd6faa56609ce94f07ed071cd076b2e4e8aa6c9ce966a5d84",
        "aspect": "d9bfb7b6c76150230c8931549d47fa715623464e888d2d4b1094fbb2163c63f0",
        "landform": "db31953551020f9fecde20fe6219fcc56a783ca0e56de92dc2ec3a73ed349f33",
    },
    (42, 16): {
        "h": "7a478a63126d39241c63fe654232f680a5b8e0b7907e2bd3d6b2c4b5cf60c210",
        "r": "a66ef7fd25e1192270dcc4e631395411a7ac9f064ccf433b14d07114ed31d1fd",
        "v": "6cdd51f402c61aa70fddfff896cc7123e81d8deb7cf552fe3391d5a15cef44ab",
        "slope": "e4d92b60d3ac05470943ec0332f1f85db1dbf62d43a5224bdca6ce04caf79d1e",
        "aspect": "75db33c803dc1608d90718eb3ea7fc6208c75ff216e6317a8faca357e8c5b4c8",
        "landform": "9dbc6d9df236f18f74937f63186fa8624a02c5379f34770f9c739a2c5924001d",
    },
    (42, 64): {
        "h": "0a7349fd0595db36d879b1641275436a04aa0b71e10f9cb1329a474d1b133816",
        "r": "acf442ba992280df0609177cdb9a9ea068069886a8b4460a1b2226168baa8cee",
        "v": "9662141106dff4711a723de33163c7f74fd4aadf98714d5bbb5989741d5aa467",
        "slope": "ace6136d092590b2f1f856fc893e51f01e25fcd8b4e889e68b3a1d7e9f703556",
        "aspect": "fabe9c7616a6ec5e9530d29a1845f1acfffd0d4befe6f643d61ded8967143fd0",
        "landform": "bc0becb8746ddc206128445ea58e79cf4085cd4d992833f548c4e16d5ea3bedb",
    },
    (123456789, 16): {
        "h": "ce2b04a17452e9cedcddfe7ca32f51ae91024f3b7af8fe7e7b668d827e010b65",
        "r": "7d74177e3014f7261f3fd8eb36b508f032ebb8e43bac9bbc81cc422f069071e6",
        "v": "77511c306e22ad35052ab4aed23a79dac0980f29595315cad67e67c552307137",
        "slope": "ef93a12789b3d7b73b4a615843815882b81868bd8712d3be0e4640bbf3a1c924",
        "aspect": "71df4dad923dec88a11d2293fc31a69544c6167a78bb01230c9ed366a170119f",
        "landform": "e1a86c9b48255e5dcfde012503a1ba6cbe152442fee2e48ee071797445888f44",
    },
    (123456789, 64): {
        "h": "e0a74d4bb232be1a41a7f7b64033e18a0c8565381b3f79eb434fd136a752897c",
        "r": "b9fd11d877b2beb94ff252f72887926148e73bc48b3cdd068e3408bd9bcf9f2f",
        "v": "371742d1404b096aed39bee98d7ff1f480afe25d152541a298cd4c8c9414d881",
        "slope": "cbc1c212680634a2405539087551746c1b00e4a20d2feb49ab8ca0e82bda9109",
        "aspect": "1f3143e5f1d8ad156586e31801713b989b6eeb7e45b5ad145f412c8132a9bb29",
        "landform": "f704fd7467e26a4de3ad6f6d0f34b1979f1222c21c342fdc5c86983c2e88eff3",
    },
    (18446744073709551615, 16): {
        "h": "96606c78d329d2a35f6cae46d20e5fb3ddd5469de8a18fa4587cc121f2e25221",
        "r": "c6e83345fb1c5d3596264cd1787a02f3d0f60a90a7562c3f87dd1708e04f9db0",
        "v": "dd63235937d350cede1ede9cf5af27c51bf663cfa513d728f75bd6b9c762e54a",
        "slope": "6f1e68ed71cecfa69d60c53ac2270c875fb1b82940991df7178b0c64bca86875",
        "aspect": "78764d30f20cf5487608524b58b5f54b523bc770a3c9386114d5e38c7337e6e5",
        "landform": "5c81dec4a8d6e6de9109e0a84f9085b7d2cbbdbd0dc625bd7f415f13083da6b0",
    },
    (18446744073709551615, 64): {
        "h": "a2293ad2b893533c30f12a17f40c9602443954d7bed100f06783b886b13cedc5",
        "r": "17a24e681430688c76cee4cd5a371403600dca16e73fea39337a2df09e2f53dc",
        "v": "362ca231cd139bae88d47dd52c8e88aeeeabe3236d1257dcd664199cd2a56c28",
        "slope": "09a423c447e1a064ed311400bfadc107418ea1725cfdeead6fa23e418fcc4fdd",
        "aspect": "49422c2a6d8d6b1e5ab54382361fc0aa9b91525a885d59bbf570c76030e39690",
        "landform": "0606c320daa5a1025394974adf18886667d9139caca71d56ec5396de258c6adb",
    },
}
#: Trail cost, move cost (32-bit floats), trails and their ids (32-bit integers), ways (16 bits), cliffs and what can be followed (bytes).
NAVIGATION = {
    (1, 16): {
        "trail_cost": "9aca95b20816e19f24efb0f8ce093f1e9833d3f8cd79525c3a8fdc910f0f4bbd",
        "trail": "2cc9773375fb99603b80250aec82661262494e9b88cb5525081e98b16d0344c8",
        "trail_id": "fa1c3d556ca500a22c6b075e704623a0a7d2fd2678a27154fbf465d7311fd0a1",
        "move_cost": "2a959eb160373639e4da1e1c16984abfcb78f3b97c38f55ced02de8370254cf4",
        "pass_packed": "76af2a36ea60973071462df48a1e98dc8f7dcbc5d04c9b13fdcd452c09c685cf",
        "cliff_packed": "5341e6b2646979a70e57653007a1f310169421ec9bdd9f1a5648f75ade005af1",
        "follow": "8f503758f19305c47de2a4b4fdd0d8ad57ff98e4f8226a5b807605820dfb4c8a",
    },
    (42, 16): {
        "trail_cost": "d1a09b64080ec54591b2f02de05293ed23f3f7e6b203359f6d882755bc2c1870",
        "trail": "e3922dcdc791c0ebe4a68862d75725e53b4de0390b99c62239faeaf8c11fd7b1",
        "trail_id": "82f9d1930e45dfda930763c9313a3f9f8a84b3576eaa8a33373528232879a292",
        "move_cost": "8df145cc3e5114c06b0a4b64846fbebeb23c392b535b4883b8e633966759e513",
        "pass_packed": "1c5b88543a65122bb48c50e32886565c5731e3cc5203e63569bc787e55bb3b0b",
        "cliff_packed": "5341e6b2646979a70e57653007a1f310169421ec9bdd9f1a5648f75ade005af1",
        "follow": "5109b491e1925e8d159147f4d325dd920ade6dd1ed910a36da15279b945870cb",
    },
    (123456789, 16): {
        "trail_cost": "bd7b82e42a0cac203326f59880d26bf507d79040b7f739efa570f9be47e7dc63",
        "trail": "7d39b7d7bc3ec1724574d8c85b94f0ed3e77e8099349e844709b2b507deeddba",
        "trail_id": "2174bb017949499361f568e688985722d31e9085b68620e4101612425ad975aa",
        "move_cost": "81c269bb122b231befed71e47710bf04bbffd3b47fc77220824c1b1ee8d401ed",
        "pass_packed": "c0808f3a77968b3b381969e68306e53c154ac76d5d81cef821d4b9b6449e1ebc",
        "cliff_packed": "5341e6b2646979a70e57653007a1f310169421ec9bdd9f1a5648f75ade005af1",
        "follow": "20e7d5ca82305c99a21e6ad86a529870b22a65237c75f7a4eed9a17bb2712a03",
    },
    (18446744073709551615, 16): {
        "trail_cost": "577ba7155cfb32391e6318a7f5092a1d6d5083ea32e4a9095a4a3152eb81e249",
        "trail": "db01e67f47a347d1f83824fc950cce1596ead51b80edd536242b61dfd9ef5862",
        "trail_id": "dd33edc9adbf08ba944fcf179c83f4980f89b21c1f2f8fbb1960a1eb32c7f684",
        "move_cost": "e6b14a27874b17607a28731912abfa2a6bae95233559ef70743b11e200555e7e",
        "pass_packed": "7e7f8d1b9fde5deaf5161f34a47015fe0a3212a802eb7bcbe9d63913f78747f0",
        "cliff_packed": "5341e6b2646979a70e57653007a1f310169421ec9bdd9f1a5648f75ade005af1",
        "follow": "b1fa0a6df7a349e0416fda2639c9e4cc6a45766f217dfd36c1dd4b841c6e02aa",
    },
}
